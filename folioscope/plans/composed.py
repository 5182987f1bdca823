"""More queries with their DuckDB SQL: procedures, manuals, variants and results that
are composed of the plain tables, through the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import dealt, spread
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import procedures as P
from ..operators import quality as Q
from ..operators import rollup as U
from ..operators import similarity as V
from ..operators import structure as S
from . import queries as plain
from .queries import ORACLE_SQL, QUERIES, documents, order_documents, query, read  # noqa: F401  registered in the same tables

# --- manuals: pages of text ---------------------------------------------------------

_MANUALS = """p as (select 'M' || (p_partkey % 40) as doc, (p_partkey // 40)::int as page,
    ['Manual M' || (p_partkey % 40) || '  Rev 2', p_name, 'Size ' || p_size, p_brand, p_type, 'Page ' || (p_partkey // 40 + 1) || ' of 50'] as l from part)"""


def manual_pages(spark, sf_dir) -> DataFrame:
    """Parts as the pages of forty manuals: a header, a size and a page number recur."""
    k = F.col("p_partkey")
    doc, page = F.concat(F.lit("M"), (k % 40).cast("string")), F.floor(k / 40).cast("int")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Manual "), doc, F.lit("  Rev 2")), "p_name", F.concat(F.lit("Size "), F.col("p_size").cast("string")), "p_brand", "p_type",
        F.concat(F.lit("Page "), (page + 1).cast("string"), F.lit(" of 50")),
    )
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(doc.alias("doc"), page.alias("page"), text.alias("text"))


@query(f"""with {_MANUALS}, x as (select doc, page, unnest(range(0, 6)) as idx, unnest(l) as line from p),
  z as (select *, case when idx < 3 then 'top' else 'bottom' end as zone, lower(regexp_replace(regexp_replace(trim(line), '\\s+', ' ', 'g'), '\\d+', '#', 'g')) as key from x),
  c as (select doc, zone, key, count(distinct page) as n from z group by all), m as (select doc, count(distinct page) as pages from z group by 1)
  select doc, page, idx::int as idx, case when n >= greatest(2, ceil(pages * 0.6 - 1e-9)) then 'repeated-furniture' else 'kept' end as mark from z join c using (doc, zone, key) join m using (doc)""")
def a10_furniture(spark, sf_dir):
    rows = I.mark_furniture(I.page_lines(manual_pages(spark, sf_dir)))
    return rows.select("doc", "page", "idx", F.coalesce("drop", F.lit("kept")).alias("mark"))


_MARKS = r"""[.,;:()\[\]—–"'']+"""


@query(rf"""with l as (select trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\s+', ' ', 'g')) as line from documents),
  w as (select string_split(line, ' ') as t from l), i as (select unnest(t[2:len(t) - 1]) as token from w where len(t) > 2),
  k as (select distinct lower(regexp_replace(token, '^{_MARKS}|{_MARKS}$', '', 'g')) as word from i)
  select distinct case when contains(word, '-') then regexp_extract(word, '^(\p{{L}}+-\p{{L}}+)', 1) else word end as word, contains(word, '-') as compound from k
  where (contains(word, '-') and regexp_matches(word, '^\p{{L}}+-\p{{L}}+')) or (not contains(word, '-') and regexp_matches(word, '^\p{{L}}{{3,}}$'))""")
def a9_vocabulary(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return I.vocabulary(I.page_lines(pages).withColumn("drop", F.lit(None).cast("string")))


@query("""select p_partkey::varchar as doc, unnest(['owner', 'site', 'version']) as key, unnest([p_brand, p_type, p_size::varchar]) as value from part""")
def f28_label_pairs(spark, sf_dir):
    raw = F.concat(F.lit("Owner: "), "p_brand", F.lit("    Location: "), "p_type", F.lit("   Revision No: "), F.col("p_size").cast("string"))
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.lit(0).alias("page"), F.lit(0).alias("idx"), raw.alias("raw"))
    return I.label_pairs(lines).select("doc", "key", "value")


# --- text -----------------------------------------------------------------------------


@query("""select doc_id, md5(lower(strip_accents(coalesce(text, '')))) as digest from documents where not regexp_matches(coalesce(text, ''), '[^\x00-\u024F]')""")
def f14_strip_accents(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~F.col("text").rlike("[^\\x{0}-\\x{24F}]"))
    return rows.select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("digest"))


@query("""select s_suppkey as id, 'IF the flow is below ' || s_suppkey || ' units THEN stop it.' as told from supplier
  union all select s_suppkey, 'IF line ' || s_nationkey || ' is empty THEN notify the lead.' from supplier""")
def f20_conditionals(spark, sf_dir):
    from ..operators import training as TR

    first = F.concat(F.lit("If the flow is below "), F.col("s_suppkey").cast("string"), F.lit(" units,  stop it."))
    second = F.concat(F.lit("notify the lead when line "), F.col("s_nationkey").cast("string"), F.lit(" is empty."))
    lines = F.array(first, F.lit("Nothing else is said here."), second, first)
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(TR.conditionals(lines)).alias("told"))


# --- flowcharts -----------------------------------------------------------------------

_FLOWS = """o as (select l_orderkey::varchar as sop_id, count(*)::int as n, (count(*) filter (l_linenumber % 3 = 0))::int as d from lineitem group by 1)"""


def flow_documents(spark, sf_dir) -> DataFrame:
    """Orders as numbered procedures; every third step has a branch."""
    k, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("If part "), part, F.lit(" is broken again, reject the whole box now."))).otherwise(F.concat(F.lit("Record part "), part, F.lit(".")))
    step = F.struct(k.alias("k"), F.concat(k.cast("string"), F.lit(". "), text).alias("line"))
    rows = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(step)).alias("s"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("sop_id"), "s")
    body = F.concat(F.lit("Some words first.\n\nII. PACKING OF THE BOX\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit("\n\nEnd of it."))
    return rows.select("sop_id", F.concat(F.lit("Order "), "sop_id").alias("title"), body.alias("body"))


@query(f"""with {_FLOWS} select sop_id, 'Packing of the Box' as section, n as n_steps, case when n >= 3 then d else 0 end as n_decisions,
  case when n >= 3 then greatest(1, ceil((n + d) / 4.0))::int else 0 end as pages_replaced, case when n >= 3 then 'pass' else 'n/a' end as status,
  case when n >= 3 then n + d + 2 else 0 end as n_nodes, case when n >= 3 then n + 2 * d + 1 else 0 end as n_edges from o""")
def m10_flowcharts(spark, sf_dir):
    rows = P.flowcharts(flow_documents(spark, sf_dir))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    return rows.select("sop_id", "section", "n_steps", "n_decisions", "pages_replaced", "status", size("nodes").alias("n_nodes"), size("edges").alias("n_edges"))


@query(f"""with {_FLOWS}, c as (select *, greatest(1, ceil((n + d) / 4.0))::int as p from o)
  select count(*)::bigint as assessed, count(*) filter (n >= 3)::bigint as flowcharts, count(*) filter (n < 3)::bigint as without_procedure,
    sum(case when n >= 3 then d else 0 end)::bigint as decisions, sum(case when n >= 3 then p else 0 end)::bigint as pages_replaced from c""")
def n21_chart_totals(spark, sf_dir):
    return P.chart_totals(P.flowcharts(flow_documents(spark, sf_dir)))


@query(f"""with {_FLOWS}, l as (select l_orderkey::varchar as sop_id, l_linenumber as k,
    case when l_linenumber % 3 = 0 then 'If part ' || l_partkey || ' is broken again, reject the whole box now.' else 'Record part ' || l_partkey || '.' end as text from lineitem)
  select sop_id, (row_number() over (partition by sop_id order by k, text) - 1)::int as pos, k::bigint as step, case when k % 3 = 0 then 'decision' else 'process' end as type, text
  from l join o using (sop_id) where n >= 3""")
def n16_step_table(spark, sf_dir):
    return P.step_table(P.flowcharts(flow_documents(spark, sf_dir)))


# --- style ------------------------------------------------------------------------------

_STYLE = f"""{plain._ORDERS}, b as (select sop_id, 'Order Purpose Order II Procedure REVISION HISTORY none' || ' ' || string_agg(case k % 3 when 0 then 'Record part' when 1 then 'Step item must be shipped by' else 'verify it shall be packed ' || l_returnflag end, ' ') as w,
    count(*) as n, count(*) filter (k % 3 <> 1) as v, count(*) filter (k % 3 <> 0) as p, count(*) filter (k % 3 = 1) as must, count(*) filter (k % 3 = 2) as shall from o group by 1),
  c as (select *, len(string_split(w, ' ')) - 1 as words, round(100.0e0 * v / n, 1) as vf from b), e as (select *, round(100.0e0 * p / words, 2) as pw, case when must >= shall and must > 0 then 'must' when shall > 0 then 'shall' else 'none' end as modal from c)"""


@query(f"""with {_STYLE} select sop_id, modal as dominant_modal, vf as verb_first_pct, n::bigint as n_steps, p::int as passive_count, words::int as word_count, pw as passive_per_100w from e""")
def m11_style(spark, sf_dir):
    return Q.style(order_documents(spark, sf_dir)).select("sop_id", "dominant_modal", "verb_first_pct", "n_steps", "passive_count", "word_count", "passive_per_100w")


@query()
def f9_sentence_units(spark, sf_dir):
    return Q.sentence_units(order_documents(spark, sf_dir)).select("sop_id", F.col("units").cast("int").alias("units"))


# --- graph, roll-ups ----------------------------------------------------------------------


@query("""select s_suppkey::varchar as sop_id from supplier where s_suppkey % 3 <> 0 and s_suppkey not in (select s_nationkey from supplier where s_suppkey % 3 = 0)""")
def g2_orphans(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    links = rows.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst"))
    return G.orphans(rows.select(F.col("s_suppkey").cast("string").alias("sop_id")), links)


@query("""with s as (select doc_id, case when toxic = 1 then 3 when quality = 0 then 2 else 1 end as severity from labels),
  r as (select source as sop_id, coalesce(severity, 0) as s from documents left join s using (doc_id))
  select sop_id, ['n/a', 'pass', 'warn', 'fail'][max(s) + 1] as status, count(*) filter (s = 3)::bigint as fail, count(*) filter (s = 2)::bigint as warn, count(*) filter (s = 1)::bigint as pass from r group by 1""")
def a15_worst_status(spark, sf_dir):
    told = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warn").otherwise("pass")
    labels = read(spark, sf_dir, "labels").select("doc_id", told.alias("status"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("sop_id")).join(labels, "doc_id", "left")
    return U.worst_status(rows.select("sop_id", F.coalesce("status", F.lit("n/a")).alias("status")))


_RESULTS = """r as (select 'SOP-NAT-' || lpad(n_nationkey::varchar, 3, '0') as sop_id, 'm0' || n_regionkey as module, ['pass', 'warn', 'n/a'][n_nationkey % 3 + 1] as status, n_nationkey as k from nation)"""


def _results(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    id_ = F.concat(F.lit("SOP-NAT-"), F.lpad(k.cast("string"), 3, "0"))
    status = F.when(k % 3 == 0, "pass").when(k % 3 == 1, "warn").otherwise("n/a")
    finding = F.when(k % 2 == 0, F.concat(F.lit("Differs from "), id_, F.lit("-ES"))).otherwise(F.concat(F.lit("NAT-"), F.lpad(((k + 1) % 30).cast("string"), 3, "0"), F.lit(" and "), id_, F.lit(" overlap")))
    return read(spark, sf_dir, "nation").select(id_.alias("sop_id"), F.concat(F.lit("m0"), F.col("n_regionkey").cast("string")).alias("module"), status.alias("status"), F.array(finding).alias("findings"))


@query(f"""with {_RESULTS} select sop_id, module, status from r union all select sop_id || '-ES', module, status from r where status <> 'n/a' and k % 2 = 0""")
def j10_inherited(spark, sf_dir):
    rows = _results(spark, sf_dir)
    variants = rows.select(F.concat("sop_id", F.lit("-ES")).alias("variant"), F.col("sop_id").alias("en"))
    return U.with_inherited(rows, variants).select("sop_id", "module", "status")


@query(f"""with {_RESULTS} select sop_id, module, 'Differs from ' || sop_id || '-ES' as finding from r where false
  union all select 'SOP-NAT-' || lpad(((k + 1) % 30)::varchar, 3, '0'), module, 'NAT-' || lpad(((k + 1) % 30)::varchar, 3, '0') || ' and ' || sop_id || ' overlap' from r where k % 2 = 1 and (k + 1) % 30 < 25
  union all select sop_id, module, 'NAT-' || lpad(((k + 1) % 30)::varchar, 3, '0') || ' and ' || sop_id || ' overlap' from r where k % 2 = 1""")
def j11_findings_about(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return U.findings_about(rows.select("module", F.explode("findings").alias("finding")), rows)


@query("""select n_name as name, 'r' || n_regionkey as module, case when n_regionkey < 2 then 'fresh' else 'saved' end as state from nation where n_regionkey >= 2 or n_nationkey % 2 = 0""")
def j12_fresh_over_saved(spark, sf_dir):
    saved = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("module"), F.lit("saved").alias("state"), "n_regionkey", "n_nationkey")
    fresh = saved.filter("n_regionkey < 2 and n_nationkey % 2 = 0").withColumn("state", F.lit("fresh"))
    return U.merged(fresh, saved).select("name", "module", "state")


@query("""select conv_id, turn, coalesce(role <> lag(role) over (partition by conv_id order by turn), true) as changed from conversations""")
def w5_role_changes(spark, sf_dir):
    return S.changes(read(spark, sf_dir, "conversations"), "role", "turn", "conv_id").select("conv_id", "turn", "changed")


@query("""select o_orderkey as sop_id, (row_number() over (order by o_totalprice desc, o_orderkey))::bigint as rank from orders""")
def w1_ranks(spark, sf_dir):
    return Q.with_ranks(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sop_id"), "o_totalprice"), "o_totalprice").select("sop_id", "rank")


# --- scores -------------------------------------------------------------------------------

_SCORES = """s as (select p_partkey::varchar as sop_id, p_size / 5.0e0 as clarity, (p_partkey % 11)::double as completeness, (p_partkey % 7 + 1)::double as usability,
    (p_partkey % 10)::double as consistency, (p_partkey % 9)::double as defensibility from part)"""


def _scores(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.cast("string").alias("sop_id"), (F.col("p_size") / 5.0).alias("clarity"), (k % 11).cast("double").alias("completeness"), (k % 7 + 1).cast("double").alias("usability"),
        (k % 10).cast("double").alias("consistency"), (k % 9).cast("double").alias("defensibility"),
    )


_MEAN = "(clarity + completeness + usability + consistency + defensibility) / 5"
_OVERALL = f"0.65e0 * {_MEAN} + 0.35e0 * least(clarity, completeness, usability, consistency, defensibility)"


@query(f"""with {_SCORES}, o as (select *, {_OVERALL} as overall from s), l as (select sop_id, overall, greatest(clarity, 8.5e0) as clarity, completeness, usability, consistency, defensibility from o)
  select sop_id, round({_OVERALL} - overall, 9) as gain from l""")
def c6_projected_gain(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    dims = [F.col(d) for d in Q.DIMENSIONS]
    rows = rows.withColumn("overall", 0.65 * sum(dims[1:], dims[0]) / len(dims) + 0.35 * F.least(*dims))
    return rows.select("sop_id", F.round(Q.projected_gain(rows, "clarity"), 9).alias("gain"))


@query(f"""with {_SCORES}, m as (select avg(clarity) as a, avg(completeness) as b, avg(usability) as c, avg(consistency) as d, avg(defensibility) as e from s)
  select sop_id, round(sqrt((clarity - a) ** 2 + (completeness - b) ** 2 + (usability - c) ** 2 + (consistency - d) ** 2 + (defensibility - e) ** 2), 6) as distance from s, m order by 2, sop_id limit 1""")
def c7_representative(spark, sf_dir):
    return Q.representative(_scores(spark, sf_dir)).select("sop_id", F.round("distance", 6).alias("distance"))


# --- translations ---------------------------------------------------------------------------


@query("""with p as (select p_partkey as k, p_size as s, 'P' || p_partkey || ' / P' || p_partkey || '-ES' as pair from part)
  select pair, 'value' as category, s || ' ml' as en_value, (s + 1) || ' ml' as es_value, 'Values with unit ml differ' as issue from p where k % 2 = 1
  union all select pair, 'format', 'point decimals', 'comma decimals', 'Decimal signs differ' from p where k % 3 = 0
  union all select pair, 'structure', '2 sections', '1 sections', 'Numbers of sections differ' from p where k % 4 = 0
  union all select pair, 'structure', 'safety section', 'none', 'One side has no safety section' from p where k % 4 = 0""")
def n17_translation_differences(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    id_ = F.concat(F.lit("P"), k.cast("string"))
    en = F.concat(F.lit("## Scope\nadd "), s.cast("string"), F.lit(" ml at 2.5%"), F.when(k % 4 == 0, "\n## Safety\nnone").otherwise(""))
    es = F.concat(F.lit("## Alcance\nadd "), (s + k % 2).cast("string"), F.lit(" ml at "), F.when(k % 3 == 0, "2,5%").otherwise("2.5%"))
    part = spread(read(spark, sf_dir, "part"), "p_partkey")
    docs = part.select(id_.alias("sop_id"), en.alias("body"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("parent_id"))
    docs = docs.union(part.select(F.concat(id_, F.lit("-ES")), es, F.lit("es"), id_)).withColumn("full_text", F.col("body"))
    return Q.translation_differences(docs, Q.translation_pairs(docs))


# --- weights of terms -------------------------------------------------------------------------


@query("""with t as (select p_partkey::varchar as sop_id, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type || ' of the ' || p_brand), '[a-z0-9_]{2,}'), lambda w: w not in ('of', 'the')) as t from part),
  g as (select sop_id, unnest(list_concat(t, list_transform(range(1, greatest(1, len(t))), lambda i: t[i] || ' ' || t[i + 1]))) as term from t),
  tf as (select sop_id, term, count(*) as tf from g group by 1, 2), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from t),
  raw as (select sop_id, term, tf * (ln((n + 1.0) / (df + 1)) + 1) as raw from tf join df using (term), n),
  v as (select sop_id, term, raw / sqrt(sum(raw * raw) over (partition by sop_id)) as weight from raw)
  select sop_id, count(*)::bigint as n_terms, round(sum(weight), 6) as total, round(max(weight), 6) as largest from v group by 1""")
def v1_tf_idf(spark, sf_dir):
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sop_id"), F.concat_ws(" ", "p_name", "p_type", F.lit("of the"), "p_brand").alias("full_text"))
    return V.tf_idf(docs).groupBy("sop_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


@query()
def a13_cluster_terms(spark, sf_dir):
    """Terms of the brands, each a cluster; ties between equal weights have no SQL order."""
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sop_id"), "p_name", F.col("p_brand").alias("cluster"))
    return V.cluster_terms(V.tf_idf(docs, text="p_name"), docs.select("sop_id", "cluster"))
