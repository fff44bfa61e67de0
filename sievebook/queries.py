"""Registered queries: each operator on the driver's tables, with SQL for the same result where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import dates, decisions, text
from .functions import rows as row_rules
from .functions.similarity import jaro_winkler_udf, name_score_udf
from .operators import fuzzy, gate, layout, registry, search, tables
from .sources import publish

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


FOLD = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def sql_canon(x: str) -> str:
    for old, new in text.SOUNDS:
        x = f"replace({x}, '{old}', '{new}')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        x = f"replace({x}, '{c}{c}', '{c}')"
    return x


@query(f"select doc_id, {FOLD.format('text')} as folded from documents")
def fold_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


TOKENS = f"list_transform(list_filter(string_split({FOLD.format('text')}, ' '), lambda w: length(w) > 1 or regexp_matches(w, '[0-9]')), lambda w: {sql_canon('w')})"


@query(f"select item_id, array_to_string({TOKENS}, ' ') as toks, len({TOKENS}) as n from benchmark")
def canon_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t")).select("item_id", F.array_join("t", " ").alias("toks"), F.size("t").cast("long").alias("n"))


@query(f"""with t as (select doc_id, array_to_string({TOKENS}, ' ') as blob, {TOKENS} as toks from documents)
select doc_id, case when array_to_string(list_sort(toks), ' ') = 'ing the' then 0 when len(list_filter(toks, lambda x: starts_with(x, 'the'))) > 0 and len(list_filter(toks, lambda x: starts_with(x, 'ing'))) > 0 then 1 else 2 end as tier, length(blob) as size
from t where contains(blob, 'the') and contains(blob, 'ing') order by tier, size, doc_id limit 100""")
def token_search_ranked(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("toks")).withColumn("blob", F.array_join("toks", " "))
    wanted = ["the", "ing"]
    hits = rows.where(search.matches(F.col("blob"), wanted)).select("doc_id", search.tier(F.col("toks"), F.col("blob"), wanted).alias("tier"), F.length("blob").cast("long").alias("size"))
    return hits.orderBy("tier", "size", "doc_id").limit(100)


@query("""select o_orderkey, c_custkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderstatus = 'O' and n_regionkey = 3 and year(o_orderdate) = 1996""")
def facet_filter(spark, d):
    spec = search.SearchSpec(type="O", year="1996")
    orders = table(spark, d, "orders").withColumns({"type": F.col("o_orderstatus"), "applied": F.col("o_orderdate").cast("date")})
    hits = orders.where(search.facets(spec, set(orders.columns)))
    nation = table(spark, d, "nation").where("n_regionkey = 3")
    return hits.join(table(spark, d, "customer"), hits.o_custkey == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_custkey", "n_name")


@query("""select doc_id, array_to_string(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) >= 12), ',') as runs
from documents where len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) >= 12)) > 0""")
def exact_identifier_check(spark, d):
    runs = F.filter(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), lambda x: F.length(x) >= 12)
    return table(spark, d, "documents").select("doc_id", runs.alias("r")).where("size(r) > 0").select("doc_id", F.array_join("r", ",").alias("runs"))


@query("""select p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || p_partkey as key from part
where list_contains([cast(p_partkey as varchar), regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || p_partkey], regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '17')
or list_contains([cast(p_partkey as varchar)], '12345')""")
def doc_key_membership(spark, d):
    doc = F.struct(F.lit("act").alias("kind"), F.col("p_brand").alias("series"), F.col("p_partkey").cast("string").alias("number"), F.lit("").alias("raw"))
    rows = table(spark, d, "part").withColumn("doc_keys", search.doc_keys(F.array(doc)))
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    return rows.where(F.array_contains("doc_keys", F.concat(brand, F.lit("17"))) | F.array_contains("doc_keys", "12345")).select("p_partkey", F.try_element_at("doc_keys", F.lit(-1)).alias("key"))


@query("select d.doc_id, lang, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def join_enrich_left(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(f"""with k as (select doc_id, md5({FOLD.format('text')}) as key from documents)
select a.doc_id, min(b.doc_id) as first_sibling, count(*) as siblings from k a join k b on a.key = b.key and a.doc_id <> b.doc_id group by a.doc_id""")
def sibling_self_join(spark, d):
    # Siblings of a record are all of its group with another id: counted by group, no pairs are formed, and each text is folded once.
    k = table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("key"))
    w = Window.partitionBy("key")
    k = k.withColumns({"n": F.count("*").over(w), "lo": F.min("doc_id").over(w)}).where("n > 1")
    k = k.withColumns({"next": F.min(F.when(F.col("doc_id") > F.col("lo"), F.col("doc_id"))).over(w), "own": F.count("*").over(Window.partitionBy("key", "doc_id"))})
    k = k.where("n > own").select("doc_id", F.when(F.col("doc_id") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("first"), (F.col("n") - F.col("own")).alias("others"))
    return k.groupBy("doc_id").agg(F.min("first").alias("first_sibling"), F.sum("others").alias("siblings"))


@query(f"""with p as (select *, array_to_string(list_sort(string_split({FOLD.format('p_name')}, ' ')), ' ') as nm from part)
select 'part:' || nm || ':' as key, count(*) as members, min(p_partkey) as head, array_to_string(list_sort(list(distinct p_brand)), ',') as brands from p group by 1""")
def identity_groups(spark, d):
    key = registry.person_key(F.lit(None).cast("string"), F.lit("part"), F.col("p_name"), F.lit(None).cast("date"))
    return table(spark, d, "part").groupBy(key.alias("key")).agg(F.count("*").alias("members"), F.min("p_partkey").alias("head"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("select lang, doc_id, length(text) as size from (select *, row_number() over (partition by lang order by length(text) desc, doc_id) as k from documents where text is not null) where k = 1")
def longest_text_per_group(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("lang", "doc_id", F.length("text").cast("long").alias("size"))
    best = rows.groupBy("lang").agg(F.max_by(F.struct("doc_id", "size"), F.struct("size", -F.col("doc_id"))).alias("b"))
    return best.select("lang", "b.doc_id", "b.size")


@query("select o_custkey, cast(min(o_orderdate) as date) as first_on, cast(max(o_orderdate) as date) as last_on, bool_or(o_orderstatus = 'F') as any_f from orders group by o_custkey")
def first_last_any(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_on"), F.max("o_orderdate").cast("date").alias("last_on"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"))


def _scored(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("regimes"), F.count_distinct("o_orderstatus").alias("kinds"), F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last_on"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    s = registry.SCORES
    late = dates.recent(F.col("last_on"), F.lit("1998-12-31").cast("date"), s["recent_days"])
    return c.select("c_custkey", F.when(F.col("n_regionkey") == 3, s["moldova"]).otherwise(0).alias("home"), (s["regime"] * (F.col("regimes") - 1)).alias("more"), F.least(F.lit(s["mention_cap"]), s["mention"] * F.col("n")).alias("mentions"), F.when(F.col("kinds") == 2, s["both"]).otherwise(0).alias("twice"), F.when(late, s["recent"]).otherwise(0).alias("late"))


_SCORED = """with o as (select o_custkey, count(distinct o_orderpriority) as regimes, count(distinct o_orderstatus) as kinds, count(*) as n, cast(max(o_orderdate) as date) as last_on from orders group by 1),
s as (select c_custkey, case when n_regionkey = 3 then 30 else 0 end as home, 25 * (regimes - 1) as more, least(40, 5 * n) as mentions, case when kinds = 2 then 5 else 0 end as twice, case when last_on >= date '1998-12-31' - 365 then 5 else 0 end as late
from customer join o on c_custkey = o_custkey join nation on c_nationkey = n_nationkey)"""


@query(f"{_SCORED} select c_custkey, cast(home + more + mentions + twice + late as bigint) as score from s")
def score_components(spark, d):
    return _scored(spark, d).select("c_custkey", (F.col("home") + F.col("more") + F.col("mentions") + F.col("twice") + F.col("late")).cast("long").alias("score"))


@query(f"""{_SCORED} select c_custkey, concat_ws('|', case when home > 0 then 'home' end, case when more > 0 then (more // 25 + 1) || ' regimes' end, case when mentions > 0 then 'cited ' || (mentions // 5) end, case when twice > 0 then 'both' end, case when late > 0 then 'recent' end) as why from s""")
def why_array(spark, d):
    f = F.col
    parts = F.array_compact(F.array(F.when(f("home") > 0, "home"), F.when(f("more") > 0, F.concat(F.expr("more div 25 + 1").cast("string"), F.lit(" regimes"))), F.when(f("mentions") > 0, F.concat(F.lit("cited "), F.expr("mentions div 5").cast("string"))), F.when(f("twice") > 0, "both"), F.when(f("late") > 0, "recent")))
    return _scored(spark, d).select("c_custkey", F.array_join(parts, "|").alias("why"))


@query("""with dated as (select distinct l_orderkey from lineitem where l_returnflag = 'R')
select l.l_orderkey, l.l_linenumber, case when l.l_returnflag = 'R' then cast(l.l_shipdate as date) when x.l_orderkey is null then cast(o.o_orderdate as date) end as applied
from lineitem l join orders o on l.l_orderkey = o.o_orderkey left join dated x on x.l_orderkey = l.l_orderkey""")
def applied_fallback(spark, d):
    own = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("date"))
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("decisionId"), "l_linenumber", F.struct(own.alias("md")).alias("listing"))
    decisions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.lit("x").alias("regime"), F.array().cast("array<string>").alias("measures"))
    return registry.with_applied(rows, decisions).select(F.col("decisionId").alias("l_orderkey"), "l_linenumber", "applied")


@query("select o_orderkey, cast(o_orderdate as date) >= date '1998-06-30' - 365 as recent from orders")
def recent_flag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.recent(F.col("o_orderdate").cast("date"), F.lit("1998-06-30").cast("date")).alias("recent"))


@query("""with o as (select cast(o_orderdate as date) as dt from orders), b as (select greatest(date '1995-03-01', date_trunc('month', min(dt))::date) as lo, greatest(date '1995-03-01', date_trunc('month', max(dt))::date) as hi from o),
m as (select strftime(unnest(generate_series(lo, hi, interval 1 month)), '%Y-%m') as bucket from b union all select 'before'),
c as (select case when dt < date '1995-03-01' then 'before' else strftime(dt, '%Y-%m') end as bucket, count(*) as n from o group by 1)
select m.bucket, coalesce(n, 0) as count from m left join c on m.bucket = c.bucket""")
def month_histogram_dense(spark, d):
    return registry.dense_months(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")), "1995-03-01")


@query("""select l_orderkey, l_linenumber, case when datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) > 0 then datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) end as lag from lineitem join orders on l_orderkey = o_orderkey""")
def lag_days(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", dates.lag_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).cast("long").alias("lag"))


@query("select event_type, count(*) as count from events where event_type is not null and event_type <> '' group by 1")
def stats_by_type(spark, d):
    return registry.counts(table(spark, d, "events"), "event_type")


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as count from orders where o_orderdate is not null group by 1")
def stats_by_month(spark, d):
    return table(spark, d, "orders").where("o_orderdate is not null").groupBy(dates.month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("count"))


@query("select o_orderpriority, o_orderstatus, count(*) as count, min(o_orderkey) as first_seen from orders group by 1, 2")
def stats_by_program(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("count"), F.min("o_orderkey").alias("first_seen"))


@query(f"select w as word, count(*) as count from (select unnest(string_split({FOLD.format('text')}, ' ')) as w from documents) where w <> '' group by 1")
def count_exploded(spark, d):
    return table(spark, d, "documents").select(F.explode(text.words(text.fold(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@query("""select (select count(*) from documents) as rows, (select count(distinct text) from documents) as texts, (select count(*) from labels where toxic = 1) as toxic, (select count(distinct lang) from documents) as langs""")
def scalar_rollup(spark, d):
    docs = table(spark, d, "documents").agg(F.count("*").alias("rows"), F.count_distinct(F.xxhash64("text")).alias("texts"), F.count_distinct("lang").alias("langs"))
    return docs.crossJoin(table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"))).select("rows", "texts", "toxic", "langs")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_event_max_by(spark, d):
    best = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return best.select("user_id", "e.*")


@query("select case when l_linestatus = 'O' then 'found' when l_returnflag = 'N' then 'possible' else 'none' end as status, count(*) as count from lineitem group by 1")
def status_tally(spark, d):
    status = F.when(F.col("l_linestatus") == "O", "exact").when(F.col("l_returnflag") == "N", "possible").otherwise("none")
    return fuzzy.tally(table(spark, d, "lineitem").select(status.alias("status")))


@query("select o_orderkey, cast(o_orderdate as date) as applied from orders order by o_orderdate desc, o_totalprice desc, o_orderkey limit 150")
def latest_150(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").limit(150).select("o_orderkey", F.col("o_orderdate").cast("date").alias("applied"))


@query("select p_type, p_partkey, k as place from (select p_type, p_partkey, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as k from part) where k <= 5")
def category_top_k(spark, d):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_type", "p_partkey", F.row_number().over(w).alias("place")).where("place <= 5")


@query("""select id, neighbour, place from (select a.p_partkey as id, b.p_partkey as neighbour, row_number() over (partition by a.p_partkey order by abs(a.p_size - b.p_size), b.p_partkey) as place
from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey <> b.p_partkey) where place <= 6""")
def nearest_neighbours(spark, d):
    part = table(spark, d, "part").where("p_brand is not null and p_type is not null")
    return registry.nearest_by_number(part, ["p_brand", "p_type"], "p_partkey", "p_size", "p_partkey")


@query("""select dt, event_type, n, rnk from (select cast(ts as date) as dt, event_type, count(*) as n, dense_rank() over (order by cast(ts as date) desc) as rnk from events group by 1, 2) where rnk <= 12""")
def batch_dates(spark, d):
    g = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("dt"), "event_type").agg(F.count("*").alias("n"))
    newest = g.select("dt").distinct().orderBy(F.desc("dt")).limit(12).withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("dt"))))
    return g.join(F.broadcast(newest), "dt").select("dt", "event_type", "n", "rnk")


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paging(spark, d):
    return search.page(table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey")


_CANON_WORDS = f"list_transform(list_filter(string_split({FOLD.format('text')}, ' '), lambda w: w <> ''), lambda w: {sql_canon('w')})"


@query(f"""with w as (select doc_id, {_CANON_WORDS} as w from documents), g as (select distinct doc_id, w[i] || ' ' || w[i + 1] as pair from (select doc_id, w, unnest(range(1, len(w))) as i from w)),
b as (select item_id, list_filter({_CANON_WORDS}, lambda x: length(x) >= 3 and not regexp_matches(x, '^[0-9]+$')) as w from benchmark),
p as (select distinct item_id, unnest([w[1] || ' ' || w[len(w)], w[len(w)] || ' ' || w[1], w[1] || ' ' || w[2]]) as pair from b where len(w) >= 2), o as (select pair, min(item_id) as item_id from p group by pair having count(*) = 1)
select item_id, count(distinct doc_id) as cited from o join g using (pair) group by item_id""")
def bigram_mentions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("reason"), F.lit("").alias("function"), F.lit("").alias("notes"))
    grams = docs.select("id", text.canon_words(F.col("reason")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("w", i), F.try_element_at("w", i + 1))))
    grams = grams.select("id", F.explode(F.array_distinct(pairs)).alias("pair"))
    b = table(spark, d, "benchmark").select("item_id", F.filter(text.canon_words(F.col("text")), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$")).alias("w")).where("size(w) >= 2")
    first, last, second = F.element_at("w", 1), F.element_at("w", -1), F.element_at("w", 2)
    p = b.select("item_id", F.explode(F.array_distinct(F.array(F.concat_ws(" ", first, last), F.concat_ws(" ", last, first), F.concat_ws(" ", first, second)))).alias("pair"))
    sole = p.groupBy("pair").agg(F.count("*").alias("owners"), F.min("item_id").alias("item_id")).where("owners = 1")
    return sole.join(grams, "pair").select("item_id", "id").distinct().groupBy("item_id").agg(F.count("*").alias("cited"))


@query("select doc_id, lang from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1) and not exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)")
def anti_semi(spark, d):
    labels = table(spark, d, "labels")
    return table(spark, d, "documents").join(labels.where("quality = 1"), "doc_id", "left_semi").join(labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", "lang")


def _names(spark, d):
    return table(spark, d, "part").select("p_name").distinct()


@query(f"""with n as (select distinct p_name, list_transform(list_filter(string_split({FOLD.format('p_name')}, ' '), lambda w: length(w) > 1 or regexp_matches(w, '[0-9]')), lambda w: {sql_canon('w')}) as t from part), b as (select p_name, unnest(list_distinct(list_transform(t, lambda x: substr(x, 1, 2)))) as block from n)
select distinct x.p_name as a, y.p_name as b from b x join b y on x.block = y.block and x.p_name < y.p_name""")
def blocked_pairs(spark, d):
    b = _names(spark, d).select("p_name", F.explode(fuzzy.blocks(text.tokens(F.col("p_name")))).alias("block"))
    return b.select(F.col("p_name").alias("a"), "block").join(b.select(F.col("p_name").alias("b"), "block"), "block").where("a < b").select("a", "b").distinct()


@query()
def jaro_winkler_pairs(spark, d):
    return blocked_pairs(spark, d).select("a", "b", F.round(jaro_winkler_udf("a", "b"), 9).alias("score"))


@query()
def name_score_top1(spark, d):
    rows = _names(spark, d).select(F.col("p_name").alias("id"), F.xxhash64("p_name").alias("ord"), F.lit(None).cast("date").alias("birthDate"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.regexp_replace("p_name", "^(.)(.)(.)", "$1$3$2").alias("query"), F.lit("").alias("birth"))
    return fuzzy.find(asked, rows, 0.82, 1).select("query_id", "id", F.round("score", 9).alias("score"))


@query("""with i as (select o_orderkey as row_no, case when o_orderkey % 3 = 0 then lpad(cast(o_orderkey as varchar), 13, '2') when o_orderkey % 3 = 1 then 'ab' || lpad(cast(o_orderkey as varchar), 7, '0') else o_orderpriority end as q from orders)
select row_no, q as query, case when regexp_full_match(regexp_replace(q, '\\s+', '', 'g'), '[0-9]{13}') then 'idnp' when regexp_full_match(lower(regexp_replace(q, '\\s+', '', 'g')), '[a-z]{0,3}[0-9]{6,10}') then 'document' else 'name' end as kind from i""")
def batch_classify(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.lpad(k.cast("string"), 13, "2")).when(k % 3 == 1, F.concat(F.lit("ab"), F.lpad(k.cast("string"), 7, "0"))).otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select(k.alias("row_no"), raw.alias("query"))
    return rows.select("row_no", "query", fuzzy.classify(F.col("query"))[0].alias("kind"))


@query("""with m as (select doc_id, regexp_extract(text, '(\\d{1,2})[./](\\d{1,2})[./](\\d{2,4})', ['a', 'b', 'c']) as g from documents where regexp_matches(text, '\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}')),
y as (select doc_id, g, case when cast(g.c as int) < 100 then cast(g.c as int) + case when cast(g.c as int) > 30 then 1900 else 2000 end else cast(g.c as int) end as yr from m)
select doc_id, try_cast(lpad(cast(yr as varchar), 4, '0') || '-' || lpad(g.b, 2, '0') || '-' || lpad(g.a, 2, '0') as date) as found from y""")
def numeric_dates(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").rlike(r"\d{1,2}[./]\d{1,2}[./]\d{2,4}"))
    return rows.select("doc_id", dates.parse_numeric_date(F.col("text")).alias("found"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def field_after(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""select page_id, ord, word from (select page_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as ord from (select page_id, list_filter(regexp_extract_all(html, '>([^<>]*)<', 1), lambda x: trim(x) <> '') as w from pages))""")
def words_from_markup(spark, d):
    w = F.filter(F.regexp_extract_all("html", F.lit(">([^<>]*)<"), F.lit(1)), lambda x: F.trim(x) != "")
    return table(spark, d, "pages").select("page_id", F.posexplode(w).alias("ord", "word")).select("page_id", F.col("ord").cast("long").alias("ord"), "word")


@query()
def leader_clusters(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    return layout.leaders(e, ["user_id"], "sec", ["sec", "event_id"], 86400.0).select("user_id", "event_id", "cluster")


@query("""with e as (select user_id, event_id, epoch(ts)::bigint as sec from events), j as (select *, case when sec - lag(sec) over (partition by user_id order by sec, event_id) > 43200 then 1 else 0 end as jump from e)
select user_id, event_id, cast(sum(jump) over (partition by user_id order by sec, event_id rows unbounded preceding) as bigint) as cluster from j""")
def gap_clusters(spark, d):
    # The SQL's seconds are rounded, halves to even; times have fractions.
    e = table(spark, d, "events").select("user_id", "event_id", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("sec"))
    return layout.gap_clusters(e, ["user_id"], "sec", 43200).select("user_id", "event_id", "cluster")


@query("select l_orderkey, l_linenumber, greatest(cast(l_quantity + 0.5 >= 10 as int) + cast(l_quantity + 0.5 >= 20 as int) + cast(l_quantity + 0.5 >= 35 as int) - 1, 0) as bucket from lineitem")
def bucketize(spark, d):
    edges = F.array(F.lit(10.0), F.lit(20.0), F.lit(35.0))
    bucket = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("l_quantity") + 0.5)) - 1, F.lit(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bucket.alias("bucket"))


@query("""with n as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as rec from conversations)
select conv_id, cast(rec as bigint) as record, count(*) as rows, string_agg(coalesce(text, ''), ' ' order by turn) as text from n where rec > 0 group by 1, 2""")
def record_assembly(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return layout.assemble(c, ["conv_id"], ["turn"], F.col("role") == "user")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_map_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).cast("long").alias("k"))


@query("""select c_custkey, concat_ws(',', cast(c_custkey as varchar), c_name, cast(c_nationkey as varchar), '"' || c_mktsegment || '; x,y"') as line from customer""")
def csv_line(spark, d):
    return table(spark, d, "customer").select("c_custkey", publish.csv_line([F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.concat(F.col("c_mktsegment"), F.lit("; x,y"))]).alias("line"))


@query("""with c as (select c_nationkey, c_custkey, c_mktsegment, row_number() over (partition by c_nationkey order by c_custkey) as ord, c_name from customer)
select 'f' || cast(c_nationkey as varchar) as file, cast(ord as int) as ord, cast((ord - 1) % 5000 + 1 as varchar) as listNumber, 'entity' as type, c_name as name, c_mktsegment || ' n' || cast(c_nationkey as varchar) as info,
'motiv ' || cast(c_custkey as varchar) as reason, '' as dates, case when ord % 7 = 0 then 'Precizare de pe rând lat: rectificat azi aici' else '' end as notes, cast((ord - 1) // 20 + 1 as int) as page from c""")
def table_records(spark, d):
    # A file of each nation, two rows for each of its customers, 20 customers a page; every seventh has a footnote.
    c = table(spark, d, "customer")
    ord_ = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = c.select("*", ord_.alias("ord")).withColumn("at", (F.col("ord") - 1) % 20)
    word = lambda line, x, text: F.struct(F.lit(line).alias("line"), F.lit(float(x)).alias("x0"), text.cast("string").alias("text"))
    plain = lambda t: F.lit(t)
    entry = [word(0, 30, F.concat(((F.col("ord") - 1) % 5000 + 1).cast("string"), F.lit("."))), word(0, 55, F.col("c_name")), word(0, 200, F.col("c_mktsegment")), word(0, 400, plain("motiv")), word(0, 440, F.col("c_custkey")), word(1, 200, F.concat(F.lit("n"), F.col("c_nationkey")))]
    title = [word(-3, 30, plain("A.")), word(-3, 60, plain("Entități")), word(-3, 120, plain("juridice")), word(-2, 60, plain("Nume")), word(-2, 210, plain("Informații")), word(-2, 405, plain("Motivul"))]
    note = [word(2, 60 + 75 * i, plain(t)) for i, t in enumerate("Precizare de pe rând lat: rectificat azi aici".split())]
    none = F.array().cast("array<struct<line:int,x0:double,text:string>>")
    all_words = F.concat(F.array(*entry), F.when(F.col("ord") == 1, F.array(*title)).otherwise(none), F.when(F.col("ord") % 7 == 0, F.array(*note)).otherwise(none))
    placed = c.select(F.concat(F.lit("f"), F.col("c_nationkey")).alias("file"), (F.floor((F.col("ord") - 1) / 20) + 1).cast("int").alias("page"), "at", F.posexplode(all_words).alias("i", "w"))
    y = (F.col("at") * 30 + 50 + F.col("w.line") * 9).cast("double")
    words = placed.select("file", "page", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), (F.col("at") * 100 + F.col("i")).cast("int").alias("ord"), "w.x0", y.alias("y0"), (F.col("w.x0") + 20).alias("x1"), (y + 8).alias("y1"), "w.text")
    return tables.extract_table(words)[0]


_EU = "Punerea în aplicare a măsurilor restrictive internaționale ale Uniunii Europene"


@query(f"""select doc_id, case when f <> '' then substr(f, 1, 180) else 'ale uniunii europene' end as theme from (select doc_id, {FOLD.format('text')} as f from documents)""")
def decision_theme(spark, d):
    # A prefix is cut if something follows it; one that is the whole title falls to the shorter prefix, which leaves its end.
    title = F.concat(F.lit(_EU + " "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", decisions.theme(title).alias("theme"))


@query("""select o_orderkey, case when title = 'Modificarea' or (n in (18, 25, 28, 29, 30, 33, 39, 44, 47, 48, 52) and title <> 'Punerea') then 'amendment'
when title = 'Aliniere' or n in (23, 31, 35, 37) then 'alignment' else 'implementation' end as kind
from (select o_orderkey, o_orderkey % 60 as n, case o_orderstatus when 'O' then 'Punerea' when 'F' then 'Altele' else case when o_orderkey % 2 = 0 then 'Modificarea' else 'Aliniere' end end as title from orders)""")
def decision_kind(spark, d):
    title = F.when(F.col("o_orderstatus") == "O", "Punerea").when(F.col("o_orderstatus") == "F", "Altele").when(F.col("o_orderkey") % 2 == 0, "Modificarea").otherwise("Aliniere")
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 60).cast("int").alias("n"), title.alias("title"))
    return rows.select("o_orderkey", decisions.kind(F.lit("decision.pdf"), F.col("n"), F.col("title")).alias("kind"))


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as lines, count(*) filter (regexp_full_match({FOLD.format('line')}, 'anexa|lista|crt|[0-9]{{1,4}}')) as junk from l group by doc_id""")
def junk_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(row_rules.is_junk_line(F.col("line"))).alias("junk"))


@query("""with w as (select l_suppkey as file, l_linenumber as row, cast(l_partkey % 600 as double) as x0 from lineitem),
r as (select file, row, count(*) as n, max(x0) + 20 - min(x0) as span, max(cast(abs(x0 - 30) <= 12 as int)) + max(cast(abs(x0 - 170) <= 12 as int)) as hits from w group by file, row)
select file, row from r where n >= 6 and span >= 600 * 0.62 and hits < 2""")
def footnote_rows(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.lit(1).alias("page"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 600).cast("double").alias("x0"))
    pages = w.select("file", "page").distinct().withColumns({"width": F.lit(600.0), "edges": F.array(F.lit(30.0), F.lit(170.0))})
    return layout.footnote_rows(w.withColumn("x1", F.col("x0") + 20), pages).select("file", "row")


@query("""select cast(l.doc_id as varchar) as idnp, case when d.doc_id is null then 'missing' else 'reason' end as problem from labels l left join documents d on l.doc_id = d.doc_id
where l.quality = 1 and (d.doc_id is null or length(coalesce(d.text, '')) < 400)""")
def unmet_expectations(spark, d):
    none = F.array().cast("array<struct<kind:string,series:string,number:string,raw:string>>")
    records = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("idnp"), F.col("source").alias("decisionId"), F.col("text").alias("reason"), none.alias("documents"))
    wanted = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("idnp"), F.lit(None).cast("string").alias("decisionId"), F.lit(400).alias("reason_length"), F.lit(None).cast("string").alias("document"))
    return gate.problems(records, wanted)
