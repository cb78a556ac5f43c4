"""The sync relations, derived from whole tables of documents, pages and logs.

Every row of each table used takes part. Arithmetic on ids only decides attributes: file
type, folder, whether the stored hash is stale, and so on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import scalars as S

ROOT = "/rag"

PATTERN_ROWS = """
    ('en', 1L, 'drafts'), ('fr', 1L, 'drafts'), ('de', 1L, 'drafts'), ('es', 1L, 'drafts'),
    ('web', 1L, 'page_1'), ('web', 2L, '9.html'), ('bench', 1L, 'no-such-name')
"""
CONFIG_ROWS = """
    ('en', '/rag', 'Field Notes', 5L, true), ('fr', '/rag', '', 0L, false),
    ('de', '/rag', 'Notizen', 5L, true), ('es', '/rag', 'File Context', 10L, false),
    ('web', '/rag', 'Pages', 5L, true)
"""


# Columns of the tables in use; stating them saves a job per read.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


class Tables:
    """The given tables of one directory, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def document_files(self) -> DataFrame:
        folder = "CASE WHEN doc_id % 23 = 0 THEN 'drafts/' WHEN doc_id % 29 = 0 THEN '.cache/' ELSE '' END"
        kinds = "array('md','txt','py','json','pdf','png','PY','yaml','log','cfg')"
        ext = f"CASE WHEN doc_id % 31 = 0 THEN '' ELSE concat('.', {kinds}[CAST(doc_id % 10 AS INT)]) END"
        return self.read("documents").select(
            F.col("lang").alias("kb_id"),
            F.expr(f"concat('{ROOT}/', {folder}, source, '/doc_', doc_id, {ext})").alias("path"),
            F.col("text").alias("text"),
            "doc_id",
        )

    @cached_property
    def contents(self) -> DataFrame:
        """(kb_id, path, text) of every file on disk."""
        pages = self.read("pages").select(
            F.lit("web").alias("kb_id"),
            F.expr(f"concat('{ROOT}/web/page_', page_id, '.html')").alias("path"),
            F.col("html").alias("text"),
        )
        name = "CASE item_id % 3 WHEN 0 THEN 'Thumbs.db' WHEN 1 THEN 'desktop.ini' ELSE 'item.TXT' END"
        items = self.read("benchmark").select(
            F.lit("bench").alias("kb_id"),
            F.expr(f"concat('{ROOT}/bench/', item_id, '/', {name})").alias("path"),
            "text",
        )
        return self.document_files.drop("doc_id").unionByName(pages).unionByName(items)

    @cached_property
    def disk(self) -> DataFrame:
        """The listing, with keys and content hashes."""
        path = F.col("path")
        return self.contents.select(
            "kb_id",
            F.lit(ROOT).alias("root"),
            "path",
            S.rel_path(path, F.lit(ROOT)).alias("rel_path"),
            S.file_name(path).alias("filename"),
            F.lit("file").alias("kind"),
            S.file_key(path).alias("file_key"),
            S.content_hash(F.col("text")).alias("content_hash"),
        )

    @cached_property
    def state(self) -> DataFrame:
        stub = F.col("doc_id") % 19 == 0
        stored = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("stale"), 256)).otherwise(
            S.content_hash(F.col("text"))
        )
        remote_id = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.expr("concat('fid-', doc_id)"))
        docs = self.document_files.select(
            "kb_id",
            S.file_key(F.col("path")).alias("file_key"),
            F.when(~stub, F.col("path")).alias("absolute_path"),
            F.when(~stub, stored).alias("content_hash"),
            F.when(~stub, remote_id).alias("remote_file_id"),
            F.when(stub | (F.col("doc_id") % 6 == 0), F.expr("concat('note ', doc_id)")).alias(
                "context_text"
            ),
            (stub | (F.col("doc_id") % 11 == 0)).alias("context_dirty"),
        )
        path = F.expr(f"concat('{ROOT}/chat/conv_', conv_id, '/turn_', turn, '.txt')")
        chats = self.read("conversations").select(
            F.lit("chat").alias("kb_id"),
            S.file_key(path).alias("file_key"),
            path.alias("absolute_path"),
            S.content_hash(F.col("text")).alias("content_hash"),
            F.expr("concat('cid-', conv_id, '-', turn)").alias("remote_file_id"),
            F.when(F.col("role") == "system", F.col("role")).alias("context_text"),
            F.lit(False).alias("context_dirty"),
        )
        return docs.unionByName(chats)

    @cached_property
    def remote(self) -> DataFrame:
        docs = self.document_files.select(
            "kb_id",
            F.col("doc_id").alias("pos"),
            F.expr("concat('fid-', doc_id)").alias("remote_file_id"),
            S.file_name(F.col("path")).alias("filename"),
        )
        chats = self.read("conversations").select(
            F.lit("chat").alias("kb_id"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
            F.expr("concat('cid-', conv_id, '-', turn)").alias("remote_file_id"),
            F.expr("concat('turn_', turn, '.txt')").alias("filename"),
        )
        return docs.unionByName(chats)

    @cached_property
    def patterns(self) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {PATTERN_ROWS} AS t(kb_id, line_no, pattern)")

    @cached_property
    def config(self) -> DataFrame:
        names = "kb_id, target_directory, context_header_label, max_concurrent_uploads, convert_to_markdown"
        return self.spark.sql(f"SELECT * FROM VALUES {CONFIG_ROWS} AS t({names})")

    @cached_property
    def roots(self) -> DataFrame:
        kbs = "('en'), ('fr'), ('de'), ('es'), ('web'), ('bench'), ('chat')"
        return self.spark.sql(f"SELECT kb_id, '{ROOT}' AS root FROM VALUES {kbs} AS t(kb_id)")

    # One knowledge base whose listing repeats names: files from documents, the
    # remote listing from events.

    @cached_property
    def heal_inventory(self) -> DataFrame:
        name = F.expr("concat('n_', doc_id div 2, '.md')")
        rows = self.read("documents").select(
            F.lit("main").alias("kb_id"),
            F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/"), name).alias("path"),
            name.alias("filename"),
            F.lit("file").alias("kind"),
            S.content_hash(F.col("text")).alias("content_hash"),
            "doc_id",
        )
        return rows.withColumn("rel_path", S.rel_path(F.col("path"), F.lit(ROOT))).withColumn(
            "file_key", S.file_key(F.col("path"), F.col("filename"))
        )

    @cached_property
    def heal_state(self) -> DataFrame:
        types = "array('click','view','error','purchase','signup')"
        kind = F.expr(f"concat('rid-', {types}[CAST(doc_id % 5 AS INT)])")
        return self.heal_inventory.select(
            "kb_id",
            "file_key",
            F.col("path").alias("absolute_path"),
            "content_hash",
            F.when(F.col("doc_id") % 4 != 0, kind).alias("remote_file_id"),
            F.lit(None).cast("string").alias("context_text"),
            (F.col("doc_id") % 11 == 0).alias("context_dirty"),
        )

    @cached_property
    def heal_remote(self) -> DataFrame:
        return self.read("events").select(
            F.lit("main").alias("kb_id"),
            F.col("event_id").alias("pos"),
            F.concat(F.lit("rid-"), "event_type").alias("remote_file_id"),
            F.expr("concat('n_', user_id, '.md')").alias("filename"),
        )

    # Delivery logs from events.

    @cached_property
    def attempts(self) -> DataFrame:
        code = F.expr(
            "CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 500 WHEN 'error' THEN 503 "
            "WHEN 'purchase' THEN 429 ELSE 400 END"
        )
        request = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
        return self.read("events").select(
            request.alias("request_id"), F.col("event_id").alias("seq"), code.alias("code")
        )

    @cached_property
    def polls(self) -> DataFrame:
        status = F.expr(
            "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' "
            "WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' END"
        )
        request = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
        return self.read("events").select(
            request.alias("file_id"), F.col("event_id").alias("seq"), status.alias("status")
        )

    # Changes of files from events, and what a stream knew of them before from customers.

    @cached_property
    def changes(self) -> DataFrame:
        kind = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'context' ELSE 'upsert' END"
        return self.read("events").select(
            F.lit("main").alias("kb_id"),
            F.expr("concat('u', user_id)").alias("file_key"),
            F.expr(f"concat('{ROOT}/u', user_id, '.md')").alias("path"),
            F.expr(f"IF({kind} = 'upsert', sha2(concat(event_type, event_id % 7), 256), NULL)").alias("content_hash"),
            F.expr(kind).alias("op"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def stream_state(self) -> DataFrame:
        path = f"IF(c_nationkey % 4 <> 0, concat('{ROOT}/u', c_custkey, '.md'), NULL)"
        stored = f"IF({path} IS NULL, NULL, sha2(concat('click', c_custkey % 7), 256))"
        return self.read("customer").select(
            F.lit("main").alias("kb_id"),
            F.expr("concat('u', c_custkey)").alias("file_key"),
            F.expr(path).alias("absolute_path"),
            F.expr(stored).alias("content_hash"),
            F.expr("IF(c_custkey % 6 = 0, '', concat('fid-', c_custkey))").alias("remote_file_id"),
            F.expr("IF(c_nationkey % 3 = 0, concat('note ', c_custkey), NULL)").alias("context_text"),
            F.expr("c_nationkey % 5 = 0").alias("context_dirty"),
            F.expr("CASE c_custkey % 3 WHEN 1 THEN 10L WHEN 2 THEN 100000000L END").alias("content_seq"),
            F.expr("CASE c_custkey % 4 WHEN 1 THEN 5L WHEN 2 THEN 100000000L END").alias("context_seq"),
            F.expr(path).alias("wanted_path"),
            F.expr(f"IF(c_custkey % 8 = 0, sha2('open', 256), {stored})").alias("wanted_hash"),
            F.expr(f"{path} IS NULL AND c_custkey % 2 = 0").alias("is_deleted"),
        )

    @cached_property
    def poll_bodies(self) -> DataFrame:
        """Answers to polls: some without a status, some that cannot be read, some errors."""
        request = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
        code = "IF(event_type = 'error', 503, 200)"
        body = (
            """CASE WHEN event_type = 'click' THEN '{"status":"pending"}' WHEN event_type = 'view' THEN '{}' """
            """WHEN event_type = 'purchase' THEN '{"status":"completed","n":1}' WHEN event_type = 'error' THEN 'busy' """
            """WHEN event_id % 2 = 0 THEN '{"status":"failed"}' WHEN event_id % 3 = 0 THEN '{"status":7}' """
            """ELSE '<html>' END"""
        )
        return self.read("events").select(
            request.alias("file_id"), F.col("event_id").alias("seq"), F.expr(code).alias("code"), F.expr(body).alias("body")
        )
