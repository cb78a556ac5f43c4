"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators import (
    contexts,
    delivery,
    filters,
    ingest,
    orphans,
    pattern_index,
    payload,
    reconcile,
    reports,
    state_ops,
)
from docsync.operators import payload_parts as parted
from docsync.operators.skew import lookup_by_kb, set_down
from docsync.plans import full_sync as sync
from docsync.sources import config as config_source
from docsync.sources import doctree, ragignore, remote_json
from docsync.sources.tables import Tables
from docsync.streaming import microbatch

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SEARCH = "SRC1"
KV_NAMES = {"remote_url": "endpoint"}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


# Sources


@query
def scan_inventory(t: Tables) -> DataFrame:
    """The table files themselves as a document tree, hashed byte for byte."""
    files = doctree.scan_inventory(t.spark, t.sf_dir, "tables")
    hashed = doctree.hash_files(files.select("kb_id", "path", "rel_path", "filename", "length"))
    return hashed.select("kb_id", "rel_path", "filename", "length", "content_hash")


@query
def ragignore_patterns(t: Tables) -> DataFrame:
    """Every document read as an ignore file, some lines within odd white space."""
    odd = F.expr("CASE doc_id % 3 WHEN 0 THEN decode(unhex('C2A0'), 'UTF-8') WHEN 1 THEN decode(unhex('E28083'), 'UTF-8') ELSE '' END")
    text = F.concat(odd, F.replace("text", F.lit(". "), F.concat(odd, F.lit("\n"), odd, F.lit("#"))), odd)
    texts = t.read("documents").select(F.col("doc_id").cast("string").alias("kb_id"), text.alias("text"))
    return ragignore.parse_ragignore(texts)


@query
def tracked_state(t: Tables) -> DataFrame:
    return state_ops.tracked_state(t.state)


@query
def list_tracked(t: Tables) -> DataFrame:
    return state_ops.list_tracked(t.state)


def config_kv(t: Tables) -> DataFrame:
    """Stored config fields, some absent and some unparsable, one set per customer."""
    nation = "c_nationkey"
    cells = {
        "target_directory": f"CASE WHEN {nation} < 20 THEN concat('/', lower(c_mktsegment)) END",
        "endpoint": "concat('http://', c_name, '/')",
        "remote_token": f"CASE WHEN {nation} % 2 = 0 THEN c_name END",
        "knowledge_id": "concat('kb-', c_custkey)",
        "context_header_label": f"CASE {nation} % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' END",
        "max_concurrent_uploads": f"CASE {nation} % 4 WHEN 0 THEN CAST({nation} AS STRING) "
        "WHEN 1 THEN 'many' WHEN 2 THEN '-3' END",
        "convert_to_markdown": f"CASE {nation} % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'false' END",
    }
    pairs = ", ".join(f"'{name}', {value}" for name, value in cells.items())
    return (
        t.read("customer")
        .select(
            F.expr("concat('c', c_custkey)").alias("kb_id"),
            F.expr(f"stack({len(cells)}, {pairs})").alias("field", "value"),
        )
        .filter("value IS NOT NULL")
    )


@query
def resolve_config(t: Tables) -> DataFrame:
    return config_source.resolve_config(config_kv(t), KV_NAMES)


@query
def merge_config(t: Tables) -> DataFrame:
    """Forms of every customer saved over what is stored for them."""
    form = t.read("customer").select(
        F.expr("concat('c', c_custkey)").alias("kb_id"),
        F.expr("CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE '/data' END").alias("target_directory"),
        F.expr("concat('https://', c_name)").alias("remote_url"),
        F.lit("").alias("remote_token"),
        F.expr("concat('kb-', c_custkey)").alias("knowledge_id"),
        F.lit("").alias("store_url"),
        F.expr("CASE WHEN c_nationkey % 5 = 0 THEN 'Lore' ELSE '' END").alias("context_header_label"),
        F.expr("CAST(c_nationkey % 3 AS BIGINT)").alias("max_concurrent_uploads"),
        F.expr("c_nationkey % 2 = 1").alias("convert_to_markdown"),
    )
    return state_ops.merge_config(resolve_config(t), form)


@query
def parse_kb_files(t: Tables) -> DataFrame:
    """The event listing as JSON bodies of 100 files each, read back."""
    page = F.col("pos") - F.col("pos") % 100
    files = F.transform(
        F.sort_array(F.collect_list(F.struct("pos", F.col("remote_file_id").alias("id"), "filename"))),
        lambda f: f.dropFields("pos"),
    )
    bodies = (
        t.heal_remote
        .groupBy("kb_id", page.alias("first_pos"))
        .agg(F.to_json(F.struct(files.alias("files"))).alias("body"))
    )
    return remote_json.parse_kb_files(bodies)


@query
def parse_kb_catalog(t: Tables) -> DataFrame:
    """Customers as catalogue bodies of 50 entries, in both shapes."""
    entry = F.struct(
        F.expr("concat('kb-', c_custkey)").alias("id"),
        F.expr("CASE WHEN c_nationkey % 5 <> 0 THEN c_name END").alias("name"),
        F.expr("CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END").alias("description"),
    )
    pages = t.read("customer").groupBy(F.expr("c_custkey div 50").alias("page")).agg(
        F.collect_list(entry).alias("items")
    )
    wrapped, bare = F.to_json(F.struct("items")), F.to_json("items")
    body = F.when(F.col("page") % 2 == 0, wrapped).otherwise(bare)
    broken = pages.select(F.expr("concat('{\"page\":', page, '}')").alias("body"))
    return remote_json.parse_kb_catalog(pages.select(body.alias("body")).unionByName(broken))


# State


@query
def upsert_state(t: Tables) -> DataFrame:
    delivered = t.disk.select(
        "kb_id",
        "file_key",
        F.col("path").alias("absolute_path"),
        "content_hash",
        F.concat(F.lit("up-"), "filename").alias("remote_file_id"),
    )
    return state_ops.upsert_state(t.state, delivered)


@query
def delete_state(t: Tables) -> DataFrame:
    return state_ops.delete_state(t.state, orphans_(t))


@query
def set_context(t: Tables) -> DataFrame:
    """Every file gets a note, and every labelled document a later one."""
    docs = t.document_files.join(t.read("labels"), "doc_id")
    later = docs.select(
        "kb_id",
        S.file_key(F.col("path")).alias("file_key"),
        F.expr("concat('quality ', quality)").alias("context_text"),
        F.lit(2).alias("seq"),
    )
    first = t.disk.select(
        "kb_id", "file_key", F.col("filename").alias("context_text"), F.lit(1).alias("seq")
    )
    return state_ops.set_context(t.state, first.unionByName(later))


@query
def tracked_keys(t: Tables) -> DataFrame:
    return state_ops.tracked_keys(t.disk.select("kb_id", "file_key", "path"), t.state)


@query
def tracked_key_count(t: Tables) -> DataFrame:
    return reports.tracked_key_count(t.state)


@query
def sizing_tier(t: Tables) -> DataFrame:
    return reports.sizing_tier(t.state)


# Filters


def names(t: Tables) -> DataFrame:
    return t.disk.select("kb_id", "path", "rel_path", "filename", "kind")


@query
def filter_hidden(t: Tables) -> DataFrame:
    return names(t).filter(P.is_visible(F.col("rel_path"))).select("kb_id", "path")


@query
def filter_os_files(t: Tables) -> DataFrame:
    return names(t).filter(~P.is_os_ignored(F.col("filename"))).select("kb_id", "path")


@query
def filter_extension(t: Tables) -> DataFrame:
    return names(t).filter(P.has_allowed_extension(F.col("filename"))).select("kb_id", "path")


@query
def filter_ragignore(t: Tables) -> DataFrame:
    return filters.drop_ragignored(names(t), t.patterns).select("kb_id", "path")


@query
def filter_ragignore_prefix(t: Tables) -> DataFrame:
    return filters.flag_ragignored(names(t), prefix_patterns(t), "prefix").select(
        "kb_id", "path", "is_ragignored"
    )


def prefix_patterns(t: Tables) -> DataFrame:
    rows = "('en', 1L, 'src1*'), ('fr', 1L, 'src2'), ('de', 1L, 'drafts'), ('web', 1L, 'web/page_2*')"
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS t(kb_id, line_no, pattern)")


@query
def filter_pattern_index(t: Tables) -> DataFrame:
    """Thousands of patterns, one for every third document and every fifth page."""
    docs = t.read("documents").filter("doc_id % 3 = 0")
    rules = docs.select(F.col("lang").alias("kb_id"), F.expr("concat('doc_', doc_id, '.')").alias("pattern"))
    pages = t.read("pages").filter("page_id % 5 = 0")
    rules = rules.unionByName(pages.select(F.lit("web").alias("kb_id"), F.expr("concat('page_', page_id, '.')").alias("pattern")))
    found = pattern_index.hits(names(t), rules, "path").withColumn("is_ragignored", F.lit(True))
    flagged = names(t).join(found, ["kb_id", "path"], "left")
    return flagged.select("kb_id", "path", F.coalesce("is_ragignored", F.lit(False)).alias("is_ragignored"))


@query
def filter_disposition(t: Tables) -> DataFrame:
    return filters.filter_disposition(names(t), t.patterns).select(
        "kb_id", "path", "disposition", "is_filtered"
    )


@query
def filter_summary(t: Tables) -> DataFrame:
    return reports.filter_summary(filters.filter_disposition(names(t), t.patterns))


@query
def is_text_file(t: Tables) -> DataFrame:
    return names(t).select("kb_id", "path", P.is_text_file(F.col("filename")).alias("is_text"))


@query
def is_markdown_file(t: Tables) -> DataFrame:
    return names(t).select("kb_id", "path", P.is_markdown_file(F.col("filename")).alias("is_markdown"))


@query
def search_paths(t: Tables) -> DataFrame:
    return names(t).filter(P.path_contains(F.col("path"), SEARCH)).select("kb_id", "path")


@query
def verify_hash(t: Tables) -> DataFrame:
    stored = t.state.select("kb_id", "file_key", F.col("content_hash").alias("stored"), "context_dirty")
    joined = t.disk.join(stored, ["kb_id", "file_key"], "left")
    ok = P.verify_hash(F.col("stored"), F.col("content_hash"), F.col("context_dirty"))
    return joined.select("kb_id", "path", ok.alias("verified"))


# Projections


@query
def content_hash(t: Tables) -> DataFrame:
    return t.contents.select("kb_id", "path", S.content_hash(F.col("text")).alias("content_hash"))


@query
def file_key(t: Tables) -> DataFrame:
    return names(t).select("kb_id", "path", S.file_key(F.col("path")).alias("file_key"))


@query
def path_parts(t: Tables) -> DataFrame:
    """Parts of every file path and of every page address."""
    urls = t.read("pages").select(F.lit("url").alias("kb_id"), F.col("url").alias("path"))
    name = F.col("filename")
    return (
        names(t)
        .select("kb_id", "path")
        .unionByName(urls)
        .withColumn("filename", S.file_name(F.col("path")))
        .select("kb_id", "path", "filename", S.file_ext(name).alias("ext"), S.file_stem(name).alias("stem"))
    )


@query
def ext_to_lang(t: Tables) -> DataFrame:
    return names(t).select("kb_id", "path", S.ext_to_lang(F.col("filename")).alias("fence_lang"))


@query
def upload_filename(t: Tables) -> DataFrame:
    return ingest.with_convert(names(t), t.config).select(
        "kb_id", "path", S.upload_filename(F.col("filename"), F.col("convert")).alias("upload_filename")
    )


@query
def markdown_fence(t: Tables) -> DataFrame:
    lang = S.ext_to_lang(S.file_name(F.col("path")))
    fenced = S.markdown_fence(F.col("text"), lang)
    return t.contents.select("kb_id", "path", fenced.alias("fenced"))


@query
def context_header(t: Tables) -> DataFrame:
    labelled = lookup_by_kb(t.state, t.config, F.col("file_key"))
    header = S.context_header(F.col("context_text"), F.col("context_header_label"))
    return labelled.select("kb_id", "file_key", header.alias("header"))


@query
def lossy_text(t: Tables) -> DataFrame:
    """Every page decoded after a byte that is not UTF-8 was put in front."""
    raw = F.concat(F.unhex(F.lit("FF")), F.col("html").cast("binary"))
    return t.read("pages").select("page_id", S.lossy_text(raw).alias("decoded"))


@query
def html_escape(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", S.html_escape(F.col("html")).alias("escaped"))


@query
def kb_label(t: Tables) -> DataFrame:
    return parse_kb_catalog(t).select(
        "id", S.kb_label(F.col("id"), F.col("name"), F.col("description")).alias("label")
    )


@query
def run_status_phase(t: Tables) -> DataFrame:
    detail = F.expr(
        "CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'Completed successfully' "
        "WHEN 'error' THEN concat('Error: ', props) WHEN 'purchase' THEN 'Idle' ELSE props END"
    )
    runs = t.read("events").select("event_id", detail.alias("detail"))
    status = F.col("detail")
    return runs.select(
        "event_id",
        "detail",
        S.run_status_phase(status).alias("phase"),
        S.run_status_color(status).alias("color"),
    )


@query
def normalize_base_url(t: Tables) -> DataFrame:
    """Page addresses, as they are and with slashes added."""
    url = F.col("url")
    return t.read("pages").select(
        "page_id",
        S.normalize_base_url(url).alias("base_url"),
        S.normalize_base_url(F.concat(url, F.lit("///"))).alias("slashed_url"),
    )


# Reconciliation


@query
def filename_index(t: Tables) -> DataFrame:
    return reconcile.filename_index(t.heal_inventory)


@query
def filename_paths(t: Tables) -> DataFrame:
    return reconcile.filename_paths(t.heal_inventory)


@query
def first_local_path(t: Tables) -> DataFrame:
    return reconcile.first_local_path(t.heal_inventory)


@query
def reconcile_match(t: Tables) -> DataFrame:
    return reconcile.reconcile_match(t.heal_inventory, t.heal_remote).select(
        "kb_id", "pos", "remote_file_id", "filename", "first_path"
    )


@query
def reconcile_heals(t: Tables) -> DataFrame:
    return reconcile.heal_log(t.heal_inventory, t.heal_state, t.heal_remote)


@query
def heal_summary(t: Tables) -> DataFrame:
    return reconcile.heal_summary(reconcile_heals(t))


def reconcile_(t: Tables) -> DataFrame:
    state, _ = reconcile.reconcile(t.heal_inventory, t.heal_state, t.heal_remote)
    return state


REGISTRY["reconcile"] = lambda spark, sf_dir: reconcile_(Tables(spark, sf_dir))


@query
def untracked_remote(t: Tables) -> DataFrame:
    return reconcile.untracked_remote(t.remote, t.disk, t.state)


def configured(t: Tables) -> DataFrame:
    """Knowledge bases that have a configuration: those with files, and customers, who have none."""
    customers = t.read("customer").select(F.expr("concat('c', c_custkey)").alias("kb_id"))
    return t.config.select("kb_id").unionByName(customers)


@query
def kb_file_counts(t: Tables) -> DataFrame:
    """Files per knowledge base, of every configured one; customers are those without a file."""
    return reports.kb_file_counts(t.remote, configured(t))


# Ingestion and cleanup


def accepted(t: Tables) -> DataFrame:
    return filters.filter_disposition(t.disk, t.patterns).filter("disposition = 'accepted'")


@query
def classify_files(t: Tables) -> DataFrame:
    files = accepted(t).select("kb_id", "file_key", "path", "content_hash")
    return ingest.classify_files(files, t.state).select(
        "kb_id", "file_key", "path", "action", "delete_remote_id"
    )


@query
def ingest_plan(t: Tables) -> DataFrame:
    return ingest.plan_ingest(accepted(t), t.state, t.config).drop("context_text")


@query
def upload_collisions(t: Tables) -> DataFrame:
    """Documents under their source name and type, which repeat once converted."""
    files = accepted(t).withColumn("filename", F.regexp_replace("filename", "_[0-9]+", ""))
    named = ingest.with_convert(files, t.config).withColumn(
        "upload_filename", S.upload_filename(F.col("filename"), F.col("convert"))
    )
    return ingest.upload_collisions(named)


def content_rows(t: Tables) -> DataFrame:
    plan = payload.due(ingest.plan_ingest(accepted(t), t.state, t.config))
    headed = payload.with_header(plan, t.config)
    contents = t.contents.select("kb_id", "path", F.col("text").cast("binary").alias("content"))
    return payload.attach_content(headed, contents)


def payload_rows(t: Tables) -> DataFrame:
    return payload.build_payload(content_rows(t))


PART_BYTES = 1000


@query
def payload_parts(t: Tables) -> DataFrame:
    """Payloads from contents in parts of 1000 bytes, most of them cut inside a word or character."""
    parts = parted.build_payload_parts(parted.split_content(content_rows(t), PART_BYTES))
    totals = parts.filter("is_last").withColumn("n_parts", F.col("part_no") + 1)
    return totals.select("kb_id", "path", "n_parts", "payload_bytes", "payload_hash")


@query
def chunk_payload_parts(t: Tables) -> DataFrame:
    """The windows of `chunk_payloads`, from payloads in parts."""
    return parted.chunk_payload_parts(parted.build_payload_parts(parted.split_content(content_rows(t), PART_BYTES)))


@query
def build_payload(t: Tables) -> DataFrame:
    return payload_rows(t).select(
        "kb_id", "path", "upload_filename", "action", "payload_bytes", "payload_hash"
    )


@query
def chunk_payloads(t: Tables) -> DataFrame:
    """Payloads cut into windows of 1500 words, 150 of them shared with the next."""
    return payload.chunk_payloads(payload_rows(t))


@query
def orphans_missing(t: Tables) -> DataFrame:
    return orphans.orphans_missing(t.state, t.disk)


def orphans_(t: Tables) -> DataFrame:
    return orphans.find_orphans(t.state, t.disk, t.patterns, t.roots)


REGISTRY["orphans"] = lambda spark, sf_dir: orphans_(Tables(spark, sf_dir))


# Whole runs


def frame(t: Tables) -> DataFrame:
    return sync.sync_frame(t.disk, t.state, t.remote, t.patterns)


@query
def full_sync(t: Tables) -> DataFrame:
    return frame(t).select(
        "kb_id", "file_key", "path", "action", "reason", "healed", "delete_remote_id"
    )


@query
def full_sync_state(t: Tables) -> DataFrame:
    """Tracked state after a run in which every upload goes through."""
    new_id = F.when(F.col("action").isin("NEW", "UPDATE"), F.concat(F.lit("up-"), "filename"))
    return sync.settled(frame(t).withColumn("new_remote_id", new_id))


@query
def delivery_work(t: Tables) -> DataFrame:
    """Every request of a run, deletes included, dealt out to the uploaders of each base."""
    limits = t.config.withColumn("max_concurrent_uploads", F.length("kb_id").cast("bigint") % 3 * 4)
    return sync.delivery_work(frame(t), limits)


@query
def sync_summary(t: Tables) -> DataFrame:
    return reports.sync_summary(frame(t))


@query
def sync_actions(t: Tables) -> DataFrame:
    return sync.sync_actions(frame(t))


# Context listing


def listing(t: Tables) -> DataFrame:
    return contexts.context_listing(t.disk, t.state, t.patterns)


@query
def context_listing(t: Tables) -> DataFrame:
    return listing(t)


@query
def context_page_count(t: Tables) -> DataFrame:
    return contexts.context_page_count(listing(t), SEARCH, configured=configured(t))


@query
def context_page(t: Tables) -> DataFrame:
    return contexts.context_page(listing(t), search=SEARCH, page=3)


@query
def numbered_pages(t: Tables) -> DataFrame:
    return contexts.numbered_pages(listing(t))


@query
def pager_window(t: Tables) -> DataFrame:
    counts = contexts.context_page_count(listing(t), configured=configured(t))
    return contexts.pager_strip(contexts.page_numbers(counts))


@query
def get_context(t: Tables) -> DataFrame:
    return contexts.get_context(t.state, t.config, names(t).select("kb_id", "path"))


# Delivery logs


@query
def delivery_outcome(t: Tables) -> DataFrame:
    return delivery.delivery_outcome(t.attempts)


@query
def delivery_backoff(t: Tables) -> DataFrame:
    return delivery.delivery_backoff(t.attempts)


@query
def poll_outcome(t: Tables) -> DataFrame:
    decided = F.coalesce("decided_at", F.lit(-1)).alias("decided_at")
    return delivery.poll_outcome(t.polls).select("file_id", "outcome", decided)


@query
def response_bodies(t: Tables) -> DataFrame:
    """What each answer to a poll says."""
    return remote_json.parse_status(t.poll_bodies).drop("body", "code")


@query
def poll_bodies_outcome(t: Tables) -> DataFrame:
    decided = F.coalesce("decided_at", F.lit(-1)).alias("decided_at")
    polls = remote_json.parse_status(t.poll_bodies)
    return delivery.poll_outcome(polls).select("file_id", "outcome", decided)


@query
def poll_wait(t: Tables) -> DataFrame:
    return delivery.poll_wait(remote_json.parse_status(t.poll_bodies))


@query
def rejected_bodies(t: Tables) -> DataFrame:
    """Events as listing bodies of which some are cut off and some hold a file without an id."""
    entry = F.expr(
        """concat('{"id":', IF(event_id % 97 = 5, 'null', concat('"f', event_id, '"')), ',"filename":"n', user_id, '"}')"""
    )
    bodies = listing_pages(t, entry).withColumn("kb_id", F.col("page").cast("string"))
    return remote_json.rejected_bodies(bodies).select("kb_id", "reason")


def listing_pages(t: Tables, entry: Column) -> DataFrame:
    """Listing bodies of 50 events each, (page, body), every seventh cut off."""
    rows = t.read("events").select(F.expr("event_id div 50").alias("page"), F.struct("event_id", entry.alias("e")).alias("e"))
    files = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("e")), lambda e: e["e"]))
    end = F.expr("IF(page % 7 = 3, '', ']}')")
    bodies = rows.groupBy("page").agg(F.concat(F.lit('{"files":['), files).alias("body"))
    return bodies.select("page", F.concat("body", end).alias("body"))


@query
def valid_kb_files(t: Tables) -> DataFrame:
    """Listings of three bodies each, of which a cut off body or a number for an id refuses all three."""
    entry = F.expr(
        """concat('{"id":', IF(event_id % 397 = 5, '7', concat('"f', event_id, '"')), IF(user_id % 3 = 0, '', concat(',"filename":"n', user_id, '"')), '}')"""
    )
    bodies = listing_pages(t, entry).select(
        F.expr("CAST(page div 3 AS string)").alias("kb_id"), F.expr("page % 3 * 50").alias("first_pos"), "body"
    )
    return remote_json.valid_kb_files(bodies)


@query
def valid_kb_catalog(t: Tables) -> DataFrame:
    """Customers as catalogue bodies in both shapes; one entry without an id refuses its body."""
    entry = F.expr(
        """concat(IF(c_custkey % 211 = 7, '{"name":"x"', concat('{"id":"kb-', c_custkey, '"')), IF(c_nationkey % 5 = 0, '', concat(',"description":"', c_mktsegment, '"')), '}')"""
    )
    pages = t.read("customer").groupBy(F.expr("c_custkey div 50").alias("page")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(entry)), F.lit("]")).alias("list")
    )
    wrapped = F.concat(F.lit('{"total":50,"items":'), F.col("list"), F.lit("}"))
    return remote_json.valid_kb_catalog(pages.select(F.when(F.col("page") % 2 == 0, wrapped).otherwise(F.col("list")).alias("body")))


# Change streams, as one batch


@query
def latest_changes(t: Tables) -> DataFrame:
    return microbatch.latest_changes(t.changes)


def decided_changes(t: Tables) -> DataFrame:
    return microbatch.apply_changes(microbatch.latest_changes(t.changes), t.stream_state)


@query
def apply_changes(t: Tables) -> DataFrame:
    return decided_changes(t)


@query
def stream_deletes(t: Tables) -> DataFrame:
    return microbatch.remote_deletes(decided_changes(t))


@query
def settle(t: Tables) -> DataFrame:
    """Stream state when all uploads but those of keys that end in 3 went through."""
    decided = set_down(decided_changes(t), "decided")
    due = decided.filter(F.col("action").isin("NEW", "UPDATE") & ~F.endswith("file_key", F.lit("3")))
    sent = due.select("kb_id", "file_key", F.concat(F.lit("up-"), "file_key").alias("remote_file_id"))
    return microbatch.settle(decided, sent)


@query
def committable_uploads(t: Tables) -> DataFrame:
    uploads = t.attempts.withColumn("code", F.expr("IF(code = 400, 201, code)"))
    attaches = t.attempts.withColumn("code", F.expr("IF(seq % 3 = 0, 503, 200)"))
    polls = t.polls.withColumn("status", F.expr("IF(status = 'failed', 'pending', status)"))

    def by_file(attempts: DataFrame) -> DataFrame:
        return delivery.delivery_outcome(attempts).withColumnRenamed("request_id", "file_id")

    return delivery.committable_uploads(
        by_file(uploads), delivery.poll_outcome(polls), by_file(attaches)
    )
