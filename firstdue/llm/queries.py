"""The registered queries of the operators, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstdue.llm import (
    chat, clustering, decontamination, exact, licenses, line_dedup, mixing, quality, simhash, tokens, toxicity,
    urls, whitening,
)
from firstdue.llm.registry import ORACLE, QUERIES, register, table  # noqa: F401
from firstdue.llm.text import LOWER, UPPER, blank_if_null, fenced

_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_FOLD = f"'{UPPER}', '{LOWER}'"



def _times_sql() -> str:
    """Cases of the time at which a source's schedule has asked for ``share`` of its words."""
    cases = []
    for place, knots in enumerate(mixing.SCHEDULES):
        pieces = list(zip(knots, knots[1:], strict=False))
        areas = [(t1 - t0) * (y0 + y1) / 2 for (t0, y0), (t1, y1) in pieces]
        wanted, done, times = f"(share * {sum(areas)!r}::double)", 0.0, ""
        for ((t0, y0), (t1, y1)), area in zip(pieces, areas, strict=True):
            left = f"({wanted} - {done!r}::double)"
            inner = f"{y0 * y0!r}::double + {2 * (y1 - y0) / (t1 - t0)!r}::double * {left}"
            divisor = f"({y0!r}::double + sqrt(greatest(0.0::double, {inner})))"
            inside = f"case when {divisor} > 0 then 2 * {left} / {divisor} else 0 end"
            done += area
            times += f" when {wanted} <= {done!r}::double then least({t1!r}::double, {t0!r}::double + {inside})"
        cases.append(f"when place % {len(mixing.SCHEDULES)} = {place} then case{times} else {knots[-1][0]!r}::double end")
    return " ".join(cases)


OP2_SQL = f"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as name,
    cast(len(regexp_extract_all(coalesce(text, ''), {_WORD})) as bigint) as size from documents),
per as (select source, cast(sum(size) as bigint) as source_size from d group by source),
named as (select *, row_number() over (order by source nulls last) - 1 as place from per),
weighed as (
  select *, cast([3, 1, 2][cast(place % 3 as integer) + 1] as double) as w,
    source_size * 2.0::double as full_size from named),
levels as (
  select *, (sum(source_size) over () * 1.5::double
      - coalesce(sum(full_size) over (order by full_size / w, place
          rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(w) over (order by full_size / w, place
          rows between current row and unbounded following) as level from weighed),
leveled as (
  select *, max(case when level * w <= full_size then level end) over () as the_level from levels),
targets as (
  select source, source_size, place, least(full_size, the_level * w) as target from leveled),
placed as (
  select d.*, t.source_size, t.target, t.place, cast(floor(t.target) as bigint)
    - coalesce(sum(size) over (partition by d.source order by name, doc_id
        rows between unbounded preceding and 1 preceding), 0) as room
  from d join targets t on t.source is not distinct from d.source)
select doc_id, size, source_size, target,
  cast(greatest(0, least(size, room)) + greatest(0, least(size, room - source_size)) as bigint)
    as taken,
  case when first > 0 then case {_times_sql()} end end as position
from (select *, greatest(0, least(size, room)) as first,
  (floor(target) - room + greatest(0, least(size, room)) / 2) / target as share from placed)
"""


@register("op2_mixing", OP2_SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, folder, "documents"))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", "position")
    # In the order of training; what is not taken comes last.
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


@register("op2_training_order")
def op2_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """The copies that op2's mix takes, as whole documents, in the order of training."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix_documents(documents, "position").select("doc_id", "source", "position")


OP3_SQL = f"""
with items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_ALNUM}) as w
  from benchmark),
sized as (select *, least(13, len(w)) as m from items where len(w) > 0),
item_windows as (
  select distinct item_id, m, array_to_string(w[s : s + m - 1], ' ') as g
  from sized, unnest(range(1, len(w) - m + 2)) as t(s)),
texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), {_ALNUM}) as w
  from documents),
windows as (
  select doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') as g
  from texts, (select distinct m from sized) as sizes,
    unnest(range(1, len(w) - m + 2)) as t(s)),
hits as (
  select doc_id, item_id, windows.m, s from windows
  join item_windows on windows.m = item_windows.m and windows.g = item_windows.g),
words as (select distinct doc_id, s + k as at from hits, unnest(range(0, m)) as t(k)),
hit_words as (select doc_id, count(*) as n_hit from words group by doc_id),
named as (
  select doc_id, count(distinct item_id) as n_items,
    list_sort(list(distinct cast(item_id as varchar))) as ids from hits group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from texts t left join hit_words h on h.doc_id = t.doc_id
  left join named n on n.doc_id = t.doc_id
"""


@register("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontamination.judge_contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated"
    )


# Escaped lengths: a backslash and the bar of "<|" each take one more character.
OP7_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'),
    (-7, 1, 'assistant', '\### Assistant: </turn> ok')) as v(conv_id, turn, role, text)),
sized as (
  select *, length(replace(replace(role, '\', '\\'), '<|', '<\|'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    + length('<|turn|><|says|><|end|>') as chars from turns)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
    as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, ''
    order by turn, role, text), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

#: A conversation whose texts look like the control strings of common templates.
ODD_TURNS = r"""
select cast(-7 as bigint) as conv_id, cast(turn as bigint) as turn, role, text from values
  (0, 'user', r'\### Assistant: </turn> ok'), (1, 'assistant', r'\### Assistant: </turn> ok')
  as v(turn, role, text)
"""


@register("op7_chat", OP7_SQL)
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(spark.sql(ODD_TURNS)).select(
        "conv_id", "turn", "role", chat.text_part(blank_if_null(F.col("text"))).alias("parts")
    )
    formatted = chat.assemble(chat.format_turns(turns))
    read = formatted.select(
        "conv_id", "formatted", fenced(chat.parse(F.col("formatted"))).alias("turns"),
        fenced(F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_spans")), ""))
        .alias("learned"),
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)

OP8_SQL = f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0
    then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_FOLD}) as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (
  select *, case
    when ends_with('.' || host, '.www.example.com') and starts_with(path, '/en/')
      then 'www.example.com/en/'
    when ends_with('.' || host, '.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when ends_with('.' || host, '.net') and starts_with(path, '/es/') then 'net/es/'
    when ends_with('.' || host, '.net') and starts_with(path, '/fr/') then 'net/fr/'
    when ends_with('.' || host, '.com') and starts_with(path, '/') then 'com/' end as rule
  from parts)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/')
  then 'block' else 'allow' end as verdict from ruled
"""


@register("op8_url_filter", OP8_SQL)
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@register("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    rules = quality.fit_rules(documents, table(spark, folder, "labels"))
    return quality.judge_quality(documents.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "rule", "kept",
    )


@register("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    judged = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return judged.select("doc_id", digits.alias("fingerprint"), "component_id")


#: The tokenizer's file comes with a package that every machine has.
TOKENIZER = "word_bpe_49k.json"


@register("op4_token_files")
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_corpus(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    aside = toxicity.held_out(F.col("doc_id"))
    labels = table(spark, folder, "labels")
    scored = toxicity.score_toxicity(documents, toxicity.fit(documents, labels.filter(~aside)))
    return scored.select("doc_id", aside.alias("held_out"), "score", "predicted", "evidence")


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("op5_edited_lines")
def op5_edited_lines(spark: SparkSession, folder: str) -> DataFrame:
    """op5 by edit similarity, also where SimHashes are more than four bits apart."""
    clean = line_dedup.dedup_lines(table(spark, folder, "documents"), anchored=True)
    return clean.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _licence_sql() -> str:
    known = list(licenses.SENTENCES.values())
    number = {name: k for k, name in enumerate(licenses.SENTENCES, 1)}
    cases = {"".join(f"<{number[x]}>" for x in seq): name for name, seq in licenses.RULES}
    quote = lambda values: ", ".join("'" + v + "'" for v in values)
    return f"""
with cut as (
  select doc_id, string_split_regex(translate(coalesce(text, ''), {_FOLD}),
    '{licenses.SENTENCE_END}') as s from documents),
named as (
  select doc_id, i, coalesce(list_position([{quote(known)}],
    trim(regexp_replace(s[i], '{licenses.NOT_ALNUM}', ' ', 'g'))), 0) as id
  from cut, unnest(range(1, len(s) + 1)) as t(i)),
found as (
  select *, i - lag(i) over (partition by doc_id order by i) as gap from named where id > 0),
sequences as (
  select doc_id, count(*) as n_known, string_agg(
    case when gap > {licenses.MAX_GAP} then '|' else '' end || '<' || id || '>', '' order by i)
    as sequence from found group by doc_id),
runs as (
  select doc_id, unnest(regexp_extract_all(sequence,
    '{licenses.rule_pattern(licenses.RULES, number)}')) as run from sequences),
names as (
  select doc_id, list_sort(list(distinct name)) as ids from (
    select doc_id, case {" ".join(f"when run = '{r}' then '{n}'" for r, n in cases.items())} end
      as name from runs) where name is not null group by doc_id)
select d.doc_id, coalesce(n_known, 0) as n_known, coalesce(sequence, '') as sequence,
  coalesce(array_to_string(ids, ','), '') as licenses
from documents d left join sequences s on s.doc_id = d.doc_id
  left join names n on n.doc_id = d.doc_id
"""


@register("op6_licenses", _licence_sql())
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    # Its SQL ends sentences at marks and empty lines only; op6_license_lines at lines, too.
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scanned = licenses.scan_licenses(documents, lines=False)
    return scanned.select("doc_id", "n_known", "sequence", F.array_join("licenses", ",").alias("licenses"))


@register("op6_license_lines")
def op6_license_lines(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_known", "sequence", F.array_join("licenses", ",").alias("licenses"))


OP11_START = """
with v as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) as x,
    sha256('1:' || vec_id) as name
  from embeddings where len(embedding) = 64
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
e as (select vec_id, unnest(x) as a, generate_subscripts(x, 1) as i from v),
"""
OP11_ROUND = """
d{0} as (
  select vec_id, cluster, sum((a - b) * (a - b)) as distance from e join c{0} using (i) group by all),
a{0} as (
  select vec_id, cluster, distance from d{0}
  qualify row_number() over (partition by vec_id order by distance, cluster) = 1),
"""
OP11_MOVE = """
s{0} as (
  select cluster, i, sum(a) as s, count(*) as n from a{0} join e using (vec_id) group by all),
c{1} as (
  select c{0}.cluster, i, coalesce((s - ((s % n) + n) % n) // n, b) as b
  from c{0} left join s{0} using (cluster, i)),
"""
OP11_SQL = (
    OP11_START
    + """
first as (select x, row_number() over (order by name) - 1 as cluster from v order by name limit 16),
c0 as (select cluster, unnest(x) as b, generate_subscripts(x, 1) as i from first),
"""
    + "".join(OP11_ROUND.format(r) + OP11_MOVE.format(r, r + 1) for r in range(3))
    + OP11_ROUND.format(3)
    + """
named as (
  select cluster, sha256(string_agg(cast(cast(b as bigint) as varchar), ',' order by i)) as centroid_sha256
  from c3 group by cluster)
select vec_id, cast(cluster as integer) as cluster, cast(distance as bigint) as distance,
  cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, centroid_sha256
from a3 join named using (cluster)
"""
)


@register("op11_clustering", OP11_SQL)
def op11_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, folder, "embeddings"))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


OP13_SQL = """
with d as (
  select doc_id, sha256(coalesce(text, '')) as text_sha256, row_number() over () as place from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last, place) = 1 as kept,
  text_sha256
from d window same as (partition by text_sha256)
"""


@register("op13_exact_dedup", OP13_SQL)
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.mark_copies(table(spark, folder, "documents"))
