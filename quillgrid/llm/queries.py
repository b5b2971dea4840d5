"""The thin opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.oracles import ORACLES
from quillgrid.session import ship

#: Where public tokenizer models lie on this machine; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
#: Schemas of the tools that calls are checked against.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "pattern": "^https?://"}}, "required": ["url"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "run_code": {"type": "object", "properties": {"language": {"enum": ["python", "sql", "shell"]}, "code": {"type": "string"}}, "required": ["code"]},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words_each=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str, model_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    from quillgrid.llm.pieces import sample_encodings

    got = sample_encodings(table(spark, sf_dir, "documents"), model_file, k=3)
    return got.select("doc_id", "rank", "n_pieces", F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", "decodes")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.secrets import BASE, scan

    got = scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return got.select("doc_id", *(count(k) for k in kinds), F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op4_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.suffixtree import score

    return score(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.quality import held_out, learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.winnow import decontaminate

    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.chat import format_chats

    got = format_chats(table(spark, sf_dir, "conversations"), TOOLS)
    return got.select("conv_id", "stage", "depth", "turn", "ord", "kind", "json", F.array_join("problems", ",").alias("problems"))


def op8_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.repetition import repetition

    return repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.scratch import BROADCAST_ROWS, new_path
    from quillgrid.llm.shards import Store

    store = Store(spark, new_path(spark, "store"))
    store.append(table(spark, sf_dir, "documents"))
    before = len(store.shards())
    store.compact()
    version = store.version()
    # Names of files are drawn anew in each run; a shard is told by its place in the manifest, its rows and its merges.
    listed = store.shards()
    listing = spark.createDataFrame([(s.path, i, s.rows, s.merges) for i, s in enumerate(listed)], "path string, shard int, shard_rows long, merges int")
    path = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"(shards/.*)$", 1)
    got = store.read().select("doc_id", F.length("text").cast("bigint").alias("text_chars"), path.alias("path"))
    got = got.join(F.broadcast(listing) if len(listed) <= BROADCAST_ROWS else listing, "path")
    return got.select("doc_id", "text_chars", "shard", "shard_rows", "merges", F.lit(version).alias("version"), F.lit(before).alias("n_arrivals"), F.lit(len(listed)).alias("n_shards"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str, tokenizer_file: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    from quillgrid.llm.packing import pack

    got = pack(table(spark, sf_dir, "documents"), tokenizer_file)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.whitening import whiten

    rows, w, error = whiten(table(spark, sf_dir, "embeddings"), most=32)
    explained = F.element_at(F.lit([float(x) for x in w.explained] or [0.0]), F.col("component"))
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return out.select("vec_id", "component", F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgrid.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = (op1_minhash_near_dedup, op2_sentencepiece_sampling, op3_secret_scan, op4_suffix_tree_score, op5_quality_classifier, op6_winnowing_decontamination, op7_chat_tool_linking, op8_repetition_coverage, op9_size_tiered_shards, op10_license_scan, op11_retrieval_packing, op12_embedding_whitening, op13_importance_resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
