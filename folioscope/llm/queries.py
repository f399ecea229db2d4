"""The queries of the operators in this subpackage, as `__spark_entry__.py` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import metric_join, spelling, trie
from folioscope.session import table, texts


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.sharding import shard_by_rows

    return shard_by_rows(table(spark, sf_dir, "documents"), shards=40)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.token_files import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.bpe import bpe_digests

    return bpe_digests(texts(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.minhash import near_duplicates

    return near_duplicates(texts(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.webp import media_digests

    return media_digests(texts(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.quality import score_documents, train

    docs = texts(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.langid import predict, train

    docs = texts(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.line_dedup import remove_repeated_lines

    return remove_repeated_lines(texts(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.packing import pack_documents

    return pack_documents(texts(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.hnsw import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.metric_join import similar_classes

    return similar_classes(texts(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.spelling import spelling_groups

    return spelling_groups(texts(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding, "op3_token_files": op3_token_files, "op5_bpe": op5_bpe, "op7_media": op7_media, "op10_minhash": op10_minhash, "op4_quality": op4_quality, "op8_langid": op8_langid, "op2_line_dedup": op2_line_dedup, "op9_packing": op9_packing, "op6_hnsw": op6_hnsw}
QUERIES |= {"op11_metric_join": op11_metric_join, "op12_conversation_trie": op12_conversation_trie, "op13_spelling_groups": op13_spelling_groups}

SQL: dict[str, str] = {"op11_metric_join": metric_join.SQL, "op12_conversation_trie": trie.SQL, "op13_spelling_groups": spelling.SQL}
