"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm import (
    alignment,
    chat,
    conversation_repair,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    pivot_search,
    quality_classifier,
    quality_rules,
    url_filters,
    warc,
)
from ledgerlake.llm.common import sized_join
from ledgerlake.sources.shared import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    first = F.get("occurrences", F.lit(0))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("occurrences").alias("times"), first["position"].alias("position"),
    ).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ).select("doc_id", "held_out", "score", "predicted")


@query(
    "op7_line_dedup",
    r"""with lines as (
          select doc_id, text, source, i as place, string_split(text, chr(10))[i + 1] as content
          from (select doc_id, text, source, unnest(range(len(string_split(text, chr(10))))) as i
                from documents where text is not null)),
        worded as (
          select doc_id, text, place, trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line,
                 coalesce('s' || source, 'n') as site
          from lines where regexp_matches(content, '[^\x20\x09-\x0D]')),
        spread as (
          select line, min(struct_pack(u := doc_id is null, d := doc_id, p := place)) as first
          from worded group by line having count(distinct site) >= 3),
        gone as (
          select w.doc_id, w.text, w.place from worded w join spread s using (line)
          where not (w.doc_id = s.first.d and w.place = s.first.p)),
        kept as (
          select l.doc_id, l.text, count(*) as n_lines,
                 count(*) filter (g.place is not null) as n_removed,
                 coalesce(string_agg(l.content, chr(10) order by l.place) filter (g.place is null), '') as left_text
          from (select distinct doc_id, text, place, content from lines) l
          left join (select distinct * from gone) g
            on l.doc_id = g.doc_id and l.text = g.text and l.place = g.place
          group by l.doc_id, l.text)
        select d.doc_id, coalesce(k.n_lines, 0)::int as n_lines, coalesce(k.n_removed, 0)::int as n_removed,
               length(k.left_text)::int as n_chars, md5(k.left_text) as text_md5
        from documents d left join kept k on d.doc_id = k.doc_id and d.text = k.text""",
)
def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query("op10_ngram_join")
def op10_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(
        table(spark, sf_dir, "documents"), words=3, percent=90
    ).select("doc_id", "n_shingles", "component_id", "class_id")


@query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir):
    marked = materialize(fingerprints.edit_fingerprints(table(spark, sf_dir, "documents")), "marks")
    groups = materialize(fingerprints.close_groups(marked), "groups")
    return sized_join(marked, groups, ["fingerprint"], "left").select(
        *marked.columns, F.coalesce("group", "fingerprint").alias("near_group")
    )


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_url_filters",
    r"""with captures as (
          select page_id, url, timestamp '2024-01-01' + to_seconds(page_id % 365 * 86400) as fetched_at,
                 lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) as host,
                 list_filter(string_split(regexp_extract(
                     url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+(?::\d*)?([^?#]*)', 1), '/'),
                     lambda s: s <> '') as steps
          from pages),
        hosts as (
          select host, string_split(host, '.') as labels, ascii(host[4]) + length(host) as code
          from (select distinct host from captures where host <> '')),
        sections as (
          select distinct host || '/' || steps[1] as pattern, ascii(host[4]) + length(host) as code
          from captures where host <> '' and len(steps) >= 1),
        entries as (
          select 'hosts' as list, host as pattern, timestamp '2024-01-01' + to_days((code % 120)::int) as valid_from,
                 timestamp '2024-01-01' + to_days((code % 120 + 150)::int) as valid_to
          from hosts where code % 3 = 0
          union all
          select distinct 'domains', array_to_string(labels[-2:], '.'), timestamp '2024-10-01', null::timestamp
          from hosts where len(labels) >= 2 and labels[-1] = 'org'
          union all
          select 'sections', pattern, timestamp '2024-01-01' + to_days((code % 60)::int),
                 timestamp '2024-01-01' + to_days((code % 60 + 90)::int)
          from sections where code % 3 = 1
          union all
          select 'sections', pattern, timestamp '2024-01-01' + to_days((code % 60 + 250)::int), null::timestamp
          from sections where code % 3 = 1),
        parents as (
          select distinct url, unnest(list_concat(
                     list_transform(range(1, len(string_split(host, '.')) + 1),
                                    lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                     list_transform(range(1, len(steps) + 1),
                                    lambda i: host || '/' || array_to_string(steps[:i], '/')))) as pattern
          from captures where host <> ''),
        hits as (
          select c.url, c.fetched_at, list_sort(list_distinct(list(e.list))) as lists
          from captures c join parents p on c.url = p.url join entries e on e.pattern = p.pattern
          where e.valid_from <= c.fetched_at and (e.valid_to is null or c.fetched_at < e.valid_to)
          group by c.url, c.fetched_at)
        select c.page_id, c.url, coalesce(array_to_string(h.lists, ','), '') as lists, h.lists is not null as blocked
        from captures c left join hits h on c.url = h.url and c.fetched_at = h.fetched_at""",
)
def op4_url_filters(spark, sf_dir):
    """Lists derived from ``pages``: some hosts for 150 days, all of .org from October on, and the
    first path step of further hosts (as URL prefixes), which leave their list and come back."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    day = lambda days: start + F.make_dt_interval(days.cast("int"))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", day(F.col("page_id") % 365).alias("fetched_at")
    )
    seen = pages.select(
        url_filters.host_of(F.col("url")).alias("host"), F.get(url_filters.steps_of(F.col("url")), F.lit(0)).alias("step")
    ).where("host <> ''")
    hosts = seen.select("host").distinct()
    code = F.ascii(F.substring("host", 4, 1)) + F.length("host")
    sections = seen.where(F.col("step").isNotNull() & (code % 3 == 1)).distinct()
    changes = F.array(*[
        F.struct(F.lit(action).alias("action"), day(code % 60 + after).alias("at"))
        for action, after in (("add", 0), ("remove", 90), ("add", 250))
    ])
    labels = F.split("host", r"\.")
    listed = hosts.where(code % 3 == 0).select(F.lit("hosts").alias("list"), F.col("host").alias("pattern"), code.alias("code"))
    entries = (
        listed.select("list", "pattern", F.lit("add").alias("action"), day(F.col("code") % 120).alias("at"))
        .unionByName(
            listed.select("list", "pattern", F.lit("remove").alias("action"), day(F.col("code") % 120 + 150).alias("at"))
        )
        .unionByName(
            hosts.where((F.size(labels) >= 2) & (F.element_at(labels, -1) == "org")).select(
                F.lit("domains").alias("list"), F.array_join(F.slice(labels, -2, 2), ".").alias("pattern"),
                F.lit("add").alias("action"), F.lit("2024-10-01").cast("timestamp_ntz").alias("at"),
            )
        )
        .unionByName(
            sections.select(
                F.lit("sections").alias("list"), F.concat(F.translate("host", "mo", "MO"), F.lit("/"), "step", F.lit("/")).alias("pattern"),
                F.explode(changes).alias("change"),
            ).select("list", "pattern", "change.action", "change.at")
        )
    )
    return url_filters.filter_urls(pages, entries).select(
        "page_id", "url", F.array_join("matched_lists", ",").alias("lists"), "blocked"
    )


@query(
    "op5_chat_formatting",
    r"""with turns as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        escaped as (
          select *, length(regexp_replace(regexp_replace(text, '<(\\*)(\||s>|/s>|<SYS>>|</SYS>>)', '<\\\1\2', 'g'),
                                          '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g')) as n_chars from turns)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               (7 + sum(8 + length(role) + 1 + n_chars + 8))::bigint as formatted_chars
        from escaped group by conv_id""",
)
def op5_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = rows.unionByName(planted).withColumn("parts", chat.text_parts(F.col("text")))
    formatted = chat.format_chats(turns)
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), loss.alias("loss")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat.joined(F.col("turns")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op6_warc",
    """with payloads as (
         select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes
         from pages),
       carriers as (
         select payload, max(page_id) as carrier from payloads where payload_bytes >= 1000 group by payload)
       select page_id, payload_bytes, sha1(payload) as payload_digest,
              case when carrier <> page_id then 'revisit' else 'response' end as record_type,
              case when carrier <> page_id then carrier end as refers_to
       from payloads left join carriers using (payload)""",
)
def op6_warc(spark, sf_dir):
    payload = F.col("capture.payload")
    captures = warc.resolve_revisits(
        warc.round_trip(table(spark, sf_dir, "pages")).where("capture is not null"),
        {"size": F.octet_length(payload).cast("long"), "digest": F.sha1(payload)},
    )
    about = F.get("metadata", F.lit(0))["fields"]
    page_id = F.filter(about, lambda x: x["key"] == "page_id")[0]["value"]
    return captures.select(
        F.when(page_id != "", page_id.cast("long")).alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        warc.page_id_of(F.col("capture.refers_to")).alias("refers_to"),
    )


@query(
    "op11_pivot_search",
    """with vectors as (
         select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as ints from embeddings
         where embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
       scores as (
         select q.vec_id as query_id, c.vec_id,
                list_sum(list_transform(list_zip(q.ints, c.ints), lambda z: z[1] * z[2]))::bigint as score
         from vectors q join vectors c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
       ranked as (
         select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores)
       select query_id, rank, vec_id, score from ranked where rank <= 10""",
)
def op11_pivot_search(spark, sf_dir):
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op12_alignment")
def op12_alignment(spark, sf_dir):
    return alignment.align_corpus(
        table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"),
    )


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))
