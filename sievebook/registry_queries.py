"""Registered queries of the registry: its operators on records, details and decisions made from the driver's tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import dates, decisions, extract, labels, names, text
from .functions import rows as row_rules
from .operators import catalog, fuzzy, registry, search, sheets, subjects
from .queries import query, sql_canon, table
from .sources import publish, read
from .tasks import spread

AS_OF, BASE = "2024-01-01", "https://example.org/"


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, details, decisions) with the columns of schemas: a record for each customer, a decision for each nation."""
    n, k = F.col("n_nationkey").cast("int"), F.col("c_custkey").cast("int")
    none = F.array().cast("array<string>")
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    days = lambda start, add: F.date_add(F.lit(start).cast("date"), add.cast("int"))
    title = F.when(n % 2 == 0, F.concat(F.lit("privind lista "), n.cast("string"), F.lit(" de la "), F.col("n_name"))).otherwise(F.concat(F.lit("Privind punerea în aplicare a măsurilor restrictive internaționale ale Uniunii Europene având în vedere "), F.col("n_name")))
    made = {
        "id": n.cast("string"), "number": n, "date": F.when(n % 7 != 6, days("2022-01-01", n * 37)), "title": title, "regime": F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
        "kind": F.when(n % 5 == 4, "report").when(n % 5 == 3, "amendment").otherwise("implementation"), "status": F.when(n % 6 == 5, "repealed").otherwise("in_force"),
        "measures": F.when(n % 2 == 0, F.array(F.lit("asset_freeze"), F.lit("travel_ban"))).otherwise(F.array(F.lit("asset_freeze"))), "file": F.concat(F.lit("nr. "), n.cast("string"), F.lit(".pdf")),
        "amendedBy": F.when(n % 4 == 0, F.array(((n + 1) % 25).cast("string"))).otherwise(none), "instruments": none, "theme": F.lit(None).cast("string"), "subjectCount": n * 3, "notice": F.lit(None).cast("string"), "ord": n,
    }
    decided = nation.select(*(c.alias(x) for x, c in made.items()))
    row = customer.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    doc = F.struct(F.lit("pasaport").alias("kind"), F.lit("AB").alias("series"), F.lpad(k.cast("string"), 7, "0").alias("number"), F.lit("").alias("raw"))
    made = {
        "id": F.concat_ws("-", F.col("c_nationkey").cast("string"), k.cast("string")), "decisionId": F.col("c_nationkey").cast("string"), "listNumber": (k % 97).cast("string"),
        "type": F.when(F.col("c_mktsegment") == "FURNITURE", "entity").when(F.col("c_mktsegment") == "MACHINERY", "vessel").otherwise("person"),
        "name": F.concat(F.lit("Prenume"), (k % 7).cast("string"), F.lit(" Nume"), (k % 120).cast("string")), "aliases": F.when(k % 3 == 0, F.array(F.concat(F.lit("Porecla"), (k % 50).cast("string"), F.lit(" Veche")))).otherwise(none),
        "birthDate": F.when(k % 3 != 0, days("1950-01-01", k % 4 * 1000)), "citizenship": F.array(F.when(k % 13 == 0, "Republica Moldova").otherwise("Ruritania")),
        "idnp": F.when(k % 10 == 0, F.concat(F.lit("2001"), F.lpad((k % 90).cast("string"), 9, "0"))), "documents": F.when(k % 4 == 0, F.array(doc)).otherwise(F.array().cast(f"array<{schemas.DOCUMENT}>")),
        "regime": F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), "active": k % 11 != 0, "moldova": k % 13 == 0,
        "listing": F.struct(days("2021-01-01", k % 500).alias("foreign"), F.when((F.col("c_nationkey") % 3 == 0) & (k % 2 == 0), days("2022-06-01", k % 700)).alias("md")), "page": k % 9 + 1, "ord": k,
    }
    records = row.select(*(c.alias(x) for x, c in made.items()))
    function = F.when(k % 4 == 0, "Funcții: director general; Alte informații: x").when(k % 4 == 1, "deputat").when(k % 4 == 2, "om de afaceri").otherwise("")
    reason = F.concat(F.lit("legat de Nume"), (k * 7 % 120).cast("string"), F.lit(" Prenume"), (k * 7 % 7).cast("string"))
    empty = F.lit("")
    detail = row.where(k % 5 != 0).select(F.concat_ws("-", F.col("c_nationkey").cast("string"), k.cast("string")).alias("id"), function.alias("function"), empty.alias("birthPlace"), empty.alias("gender"), reason.alias("reason"), empty.alias("notes"), empty.alias("identifiersText"), empty.alias("listingRaw"), (k % 9 + 1).alias("page"))
    return records, detail, decided


REG = """with dec as (select cast(n_nationkey as varchar) as id, n_nationkey as number, case when n_nationkey % 7 <> 6 then date '2022-01-01' + cast(n_nationkey * 37 as integer) end as date,
case when n_nationkey % 2 = 0 then 'Lista ' || n_nationkey || ' de la ' || n_name else 'Având în vedere ' || n_name end as program,
case when n_nationkey % 2 = 0 then 'privind lista ' || n_nationkey || ' de la ' || n_name else 'Privind punerea în aplicare a măsurilor restrictive internaționale ale Uniunii Europene având în vedere ' || n_name end as title, 'R' || n_regionkey as regime,
case when n_nationkey % 5 = 4 then 'report' when n_nationkey % 5 = 3 then 'amendment' else 'implementation' end as kind, case when n_nationkey % 6 = 5 then 'repealed' else 'in_force' end as status,
case when n_nationkey % 2 = 0 then ['asset_freeze', 'travel_ban'] else ['asset_freeze'] end as measures, case when n_nationkey % 4 = 0 then cast((n_nationkey + 1) % 25 as varchar) end as amended_by, n_nationkey * 3 as subject_count from nation),
sub as (select c_nationkey || '-' || c_custkey as id, cast(c_nationkey as varchar) as decision, cast(c_custkey % 97 as varchar) as nr, case c_mktsegment when 'FURNITURE' then 'entity' when 'MACHINERY' then 'vessel' else 'person' end as type,
'Prenume' || (c_custkey % 7) || ' Nume' || (c_custkey % 120) as name, case when c_custkey % 3 = 0 then 'Porecla' || (c_custkey % 50) || ' Veche' end as alias, case when c_custkey % 3 <> 0 then date '1950-01-01' + cast(c_custkey % 4 * 1000 as integer) end as birth,
case when c_custkey % 10 = 0 then '2001' || lpad(cast(c_custkey % 90 as varchar), 9, '0') end as idnp, case when c_custkey % 4 = 0 then lpad(cast(c_custkey as varchar), 7, '0') end as doc, 'R' || n_regionkey as regime, c_custkey % 11 <> 0 as active, c_custkey % 13 = 0 as moldova,
date '2021-01-01' + cast(c_custkey % 500 as integer) as source, case when c_nationkey % 3 = 0 and c_custkey % 2 = 0 then date '2022-06-01' + cast(c_custkey % 700 as integer) end as md, c_custkey % 9 + 1 as page, c_custkey as ord
from customer join nation on c_nationkey = n_nationkey),
det as (select id, case ord % 4 when 0 then 'director general' when 1 then 'deputat' when 2 then 'om de afaceri' else '' end as role, ord * 7 % 120 as a, ord * 7 % 7 as b from sub where ord % 5 <> 0),
rws as (select s.*, d.number, d.date as ddate, d.measures, d.kind as dkind, case when s.md is not null then s.md when x.decision is null then d.date end as applied,
case when s.idnp is not null then 'idnp:' || s.idnp else s.type || ':' || array_to_string(list_sort(string_split(lower(s.name), ' ')), ' ') || ':' || coalesce(cast(s.birth as varchar), '') end as key
from sub s join dec d on s.decision = d.id left join (select distinct decision from sub where active and md is not null) x on x.decision = s.decision where s.active)"""
_CANON = lambda x: sql_canon(f"lower({x})")
GROUPS = f"""{REG}, prs as (select distinct key, unnest([p1, p2]) as pair from (select key, w[1] || ' ' || w[2] as p1, w[2] || ' ' || w[1] as p2 from (select key, [{_CANON("string_split(v, ' ')[1]")}, {_CANON("string_split(v, ' ')[2]")}] as w from (select key, unnest(case when alias is null then [name] else [name, alias] end) as v from rws)))),
sole as (select pair, min(key) as key from prs group by pair having count(*) = 1),
big as (select id, {_CANON("'nume' || a")} || ' ' || {_CANON("'prenume' || b")} as pair from det),
cit as (select key, count(*) as cited from (select distinct sole.key, big.id from sole join big using (pair) except select key, id from rws) group by key),
grp as (select key, array_to_string(list(id order by coalesce(cast(applied as varchar), ''), ord), ',') as ids, first(name order by number, coalesce(cast(applied as varchar), ''), ord) as name, first(type order by number, coalesce(cast(applied as varchar), ''), ord) as type,
first(alias order by number, coalesce(cast(applied as varchar), ''), ord) as alias, first(coalesce(role, '') order by length(coalesce(role, '')) desc, ord) as role, array_to_string(list_sort(list(distinct regime)), ',') as regimes, count(distinct regime) as n_regimes,
array_to_string(list_transform(list_sort(list(distinct number)), lambda x: cast(x as varchar)), ',') as decisions, count(distinct decision) as n_decisions, max(len(measures)) as n_measures, bool_or(moldova) as moldova, min(applied) as first_applied, max(applied) as last_applied
from rws left join det using (id) group by key),
sco as (select grp.*, case when type = 'person' then coalesce(cited, 0) else 0 end as cited, case when type <> 'person' then 0 else case role when 'deputat' then 30 when 'director general' then 20 when 'om de afaceri' then 10 else 0 end end as weight, coalesce(last_applied >= date '{AS_OF}' - 365, false) as late from grp left join cit using (key)),
res as (select *, cast(case when moldova then 30 else 0 end + 25 * (n_regimes - 1) + 10 * (n_decisions - 1) + least(40, 5 * cited) + weight + case when n_measures = 2 then 5 else 0 end + case when late then 5 else 0 end + case when type <> 'person' and alias is not null then 2 else 0 end as integer) as score,
concat_ws('|', case when moldova then 'local' end, case when n_regimes > 1 then n_regimes || ' regimes' end, case when n_decisions > 1 then n_decisions || ' decisions' end, case when cited > 0 then 'cited by ' || cited end, case when weight > 0 then 'role ' || weight end, case when n_measures = 2 then 'both measures' end, case when late then 'recent' end) as why from sco)"""


def _rows(spark, d):
    s, _, dec = tables(spark, d)
    rows = registry.with_applied(s.where("active"), dec)
    return rows.withColumn("key", registry.person_key(F.col("idnp"), F.col("type"), F.col("name"), F.col("birthDate")))


def _groups(spark, d):
    return registry.groups(*tables(spark, d), AS_OF)


def _join(*columns):
    return [F.array_join(c, ",").alias(c) for c in columns]


@query(f"{GROUPS} select key, ids, name, role, regimes, decisions, case when n_measures = 2 then 'asset_freeze,travel_ban' else 'asset_freeze' end as measures, moldova, first_applied, last_applied, cited, score, why from res")
def resolved_groups(spark, d):
    g = _groups(spark, d)
    return g.select("key", "name", "role", *_join("ids", "regimes", "decisions", "measures"), "moldova", F.col("firstApplied").alias("first_applied"), F.col("lastApplied").alias("last_applied"), F.col("cited").cast("long").alias("cited"), "score", F.array_join("why", "|").alias("why"))


_SLICES = {"relevance": ("type = 'person'", 50), "international": ("type = 'person' and not moldova", 50), "moldova": ("moldova", None), "regimes": ("n_regimes > 1", 50), "entities": ("type = 'entity'", 30), "vessels": ("type = 'vessel'", 30)}
_RANKED = GROUPS + ", lst as (" + " union all ".join(f"select * from (select '{n}' as list, {i} as pos, key, ids, role, score, row_number() over (order by score desc, name, key) as place from res where {w}){f' where place <= {m}' if m else ''}" for i, (n, (w, m)) in enumerate(_SLICES.items())) + ")"


@query(f"{_RANKED} select list, key, score from lst")
def rankings(spark, d):
    parts = [df.select(F.lit(n).alias("list"), "key", "score") for n, df in registry.rankings(_groups(spark, d)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"{_RANKED} select id, first(list order by pos) as list, first(key order by pos) as key, first(score order by pos) as score from (select list, pos, key, score, unnest(string_split(ids, ',')) as id from lst where list in ('relevance', 'moldova', 'entities')) group by id")
def ranked_group_of_record(spark, d):
    return catalog.ranked_group(registry.rankings(_groups(spark, d)))


@query(f"{_RANKED} select id, first(role order by pos desc) as role from (select pos, role, unnest(string_split(ids, ',')) as id from lst where role <> '') group by id")
def role_of_record(spark, d):
    return catalog.roles(registry.rankings(_groups(spark, d)))


@query(f"{GROUPS} select string_split(ids, ',')[1] as id, ids, name, case when alias is null then 0 else 1 end as aliases, score from res")
def published_groups(spark, d):
    return catalog.slim(_groups(spark, d)).select("id", *_join("ids"), "name", F.size("aliases").alias("aliases"), "score")


@query(f"""{GROUPS} select 'type' as section, type as k, count(*) as n from rws group by type union all select 'regime', regime, count(*) from rws group by regime union all select 'month', strftime(applied, '%Y-%m'), count(*) from rws where applied is not null group by 2
union all select 'measure', m, count(*) from (select unnest(measures) as m from rws) group by m union all select 'program', program, count(*) from rws join dec on rws.decision = dec.id group by dec.id, program
union all select 'scalar', k, n from (select unnest(['subjects', 'unique', 'moldova', 'multi', 'decisions', 'inForce']) as k, unnest([(select count(*) from rws), (select count(distinct key) from rws), (select count(*) from res where moldova), (select count(*) from res where n_regimes > 1), (select count(*) from dec), (select count(*) from dec where status = 'in_force')]) as n)
union all select 'latest', first(id order by coalesce(cast(date as varchar), '') desc, number desc), 1 from dec where status = 'in_force' and kind <> 'report'""")
def statistics(spark, d):
    s = registry.stats(_rows(spark, d), _groups(spark, d), tables(spark, d)[2])
    part = lambda name, df, key: df.select(F.lit(name).alias("section"), F.col(key).alias("k"), F.col("count").cast("long").alias("n"))
    scalars = s["scalars"].select(F.lit("scalar").alias("section"), F.expr("stack(6, 'subjects', subjects, 'unique', uniqueSubjects, 'moldova', moldova, 'multi', multiRegime, 'decisions', decisions, 'inForce', inForce) as (k, n)"))
    latest = s["latestDecision"].select(F.lit("latest").alias("section"), F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    return part("type", s["byType"], "type").unionByName(part("regime", s["byRegime"], "regime")).unionByName(part("month", s["byMonth"], "month")).unionByName(part("measure", s["byMeasure"], "measure")).unionByName(part("program", s["byProgram"], "program")).unionByName(scalars).unionByName(latest)


@query(f"{REG} select id, applied from rws where applied is not null order by applied desc, coalesce(cast(ddate as varchar), '') desc, name desc, ord limit 150")
def latest_records(spark, d):
    return registry.latest(_rows(spark, d)).select("id", "applied")


@query(f"{REG} select a.id, b.id as sibling from rws a join rws b on a.key = b.key and a.id <> b.id")
def siblings(spark, d):
    return registry.siblings(_rows(spark, d))


@query(f"{REG} select id, neighbour, place from (select a.id, b.id as neighbour, row_number() over (partition by a.id order by abs(cast(a.nr as int) - cast(b.nr as int)), b.ord) as place from rws a join rws b on a.decision = b.decision and a.type = b.type and a.id <> b.id) where place <= 6")
def annex_neighbours(spark, d):
    return registry.neighbours(_rows(spark, d))


@query(f"{REG} select s.id, s.decision, det.role, d.regime as decision_regime from sub s left join det using (id) left join dec d on d.id = s.decision")
def records_with_details(spark, d):
    s, det, dec = tables(spark, d)
    j = s.join(det.select("id", "function"), "id", "left").join(F.broadcast(dec.select(F.col("id").alias("decisionId"), F.col("regime").alias("decision_regime"))), "decisionId", "left")
    return j.select("id", F.col("decisionId").alias("decision"), F.when(F.col("function").isNotNull(), text.clean_role(F.col("function"))).alias("role"), "decision_regime")


_BLOB = " || ' ' || ".join(_CANON(f"string_split(name, ' ')[{i}]") for i in (1, 2))


@query(f"""{REG}, t as (select id, {_BLOB} as nm, {_BLOB} || coalesce(' ' || {_CANON("string_split(alias, ' ')[1]")} || ' ' || {_CANON("string_split(alias, ' ')[2]")}, '') || coalesce(' ' || {_CANON("idnp")}, '') || coalesce(' ' || {_CANON("doc")} || ' ' || {_CANON("'ab' || doc")}, '') as blob from rws where type = 'person')
select id, case when nm = 'prenume1 nume1' then 0 when contains(' ' || nm, ' nume1') and contains(' ' || nm, ' prenume') then 1 when contains(nm, 'nume1') and contains(nm, 'prenume') then 2 else 3 end as tier from t where contains(blob, 'nume1') and contains(blob, 'prenume')""")
def search_names(spark, d):
    spec = search.SearchSpec.from_params({"q": "NUME1 prenume", "type": "person", "mode": "all"})
    found = search.run(search.index(_rows(spark, d)), spec)
    return found.select("id", F.when(F.array_join("name_tokens", " ") == "prenume1 nume1", 0).otherwise(F.col("tier")).alias("tier"))


@query(f"{REG} select id from rws where idnp = '2001000000010' and regime = 'R1'")
def search_identifier(spark, d):
    rows = search.index(_rows(spark, d))
    short = search.run(rows, search.SearchSpec(q="2001 0000", mode="idnp"))
    return search.run(rows, search.SearchSpec(q="2001 0000 00010", mode="idnp", regime="R1")).select("id").unionByName(short.select("id"))


@query(f"{REG} select id from rws where doc in ('0000012', '0000024')")
def search_document(spark, d):
    rows = search.index(_rows(spark, d))
    one = search.run(rows, search.SearchSpec(q="AB 000-0012", mode="document")).select("id")
    return one.unionByName(search.run(rows, search.SearchSpec(q="0000024", mode="document")).select("id")).unionByName(search.run(rows, search.SearchSpec(q="12", mode="document")).select("id"))


@query(f"{REG}, f as (select key, first(id order by name, ord) as id, min(name) as nm, first(ord order by name, ord) as lo from rws where moldova and list_contains(measures, 'travel_ban') group by key), p as (select *, row_number() over (order by nm, lo) as place, count(*) over () as n from f) select key, id from p where place > (least(2, ceil(n / 20)) - 1) * 20 and place <= least(2, ceil(n / 20)) * 20")
def search_second_page(spark, d):
    spec = search.SearchSpec(md=True, measure="travel_ban", sort="name")
    hits = search.run(search.index(_rows(spark, d)), spec)
    order = [F.collate(F.col("name"), "ro"), "ord"]
    return search.page(search.grouped(hits, order), order, 2).select("key", "id")


@query(f"""{REG} select id, case when date is null then 'Fără dată' else strftime(date, '%Y') end as year, cast(row_number() over (order by coalesce(cast(date as varchar), '0') desc, number desc) as integer) as place from dec where kind = 'implementation' and contains(replace(lower(number || ' ' || title || ' ' || regime), '_', ' '), 'nation 1')""")
def decision_catalog(spark, d):
    return catalog.catalog(tables(spark, d)[2], "Nation_1", kind="implementation").select("id", "year", "place")


@query(f"""{REG} select distinct 'regime' as facet, regime as value from rws union select 'year', strftime(applied, '%Y') from rws where applied is not null union select 'type', type from rws union select 'kind', kind from dec
union select 'decision', id from dec where kind = 'implementation' and status = 'in_force' and subject_count > 0""")
def facet_values(spark, d):
    return catalog.facet_values(_rows(spark, d), tables(spark, d)[2])


@query(f"""{REG}, nw as (select distinct applied from rws where applied is not null order by applied desc limit 12)
select applied, count(*) as records, count(*) filter (type = 'person') as persons, array_to_string(list_sort(list(distinct decision)), ',') as decisions, array_to_string(list_slice(list(name order by name, ord), 1, 14), ',') as names from rws join nw using (applied) group by applied""")
def batches_by_date(spark, d):
    return catalog.batches(_rows(spark, d)).select("applied", "records", "persons", *_join("decisions", "names"))


@query("select strftime(o_orderdate, '%Y-%m') as bucket, count(*) as count from orders group by 1 order by 2 desc, 1 limit 3")
def peak_months(spark, d):
    counted = registry.dense_months(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")), "1900-01-01")
    return catalog.peaks(counted.where("bucket <> 'before'"))


@query(f"""{REG} select 'kpi' as part, '' as k, (select count(*) from rws) as n, (select count(distinct key) from rws) as m union all select 'last', cast(max(applied) as varchar), count(*) filter (applied = (select max(applied) from rws)), 0 from rws
union all select 'recent', id, 0, 0 from (select id from rws order by applied desc nulls last, name, ord limit 7) union all select 'program', decision, n, 0 from (select decision, count(*) as n from rws group by 1 order by 2 desc, 1 limit 8)""")
def home_indicators(spark, d):
    h = sheets.home(_rows(spark, d), _groups(spark, d), tables(spark, d)[2])
    zero = F.lit(0).cast("long")
    k = h["kpis"].select(F.lit("kpi").alias("part"), F.lit("").alias("k"), F.col("records").alias("n"), F.col("subjects").alias("m"))
    last = h["kpis"].select(F.lit("last").alias("part"), F.col("last").cast("string").alias("k"), F.col("last_batch").alias("n"), zero.alias("m"))
    recent = h["recent"].select(F.lit("recent").alias("part"), F.col("id").alias("k"), zero.alias("n"), zero.alias("m"))
    return k.unionByName(last).unionByName(recent).unionByName(h["programs"].select(F.lit("program").alias("part"), F.col("decisionId").alias("k"), F.col("count").alias("n"), zero.alias("m")))


@query(f"""{REG}, own as (select * from rws where ord = 24) select 'subject' as part, id as k, name as v from own union all select 'local', id, cast(coalesce(md, ddate) as varchar) from own union all select 'sibling', b.id, b.regime from own a join rws b on a.key = b.key and a.id <> b.id
union all select 'near', id, nr from (select b.id, b.nr from own a join rws b on a.decision = b.decision and a.type = b.type and a.id <> b.id order by abs(cast(a.nr as int) - cast(b.nr as int)), b.ord limit 6)""")
def subject_sheet(spark, d):
    s, det, dec = tables(spark, d)
    own = s.where("ord = 24").select("id").first()
    sheet = sheets.subject_sheet(_rows(spark, d), det, dec, own.id, AS_OF)
    subject = sheet.subject.select(F.lit("subject").alias("part"), F.col("id").alias("k"), F.col("name").alias("v")).unionByName(sheet.subject.select(F.lit("local").alias("part"), F.col("id").alias("k"), F.col("local").cast("string").alias("v")))
    return subject.unionByName(sheet.siblings.select(F.lit("sibling").alias("part"), F.col("id").alias("k"), F.col("regime").alias("v"))).unionByName(sheet.neighbours.select(F.lit("near").alias("part"), F.col("id").alias("k"), F.col("listNumber").alias("v")))


@query(f"{REG} select 'count' as part, type as k, count(*) as n from rws where decision = '9' group by type union all select 'amends', id, number from dec where amended_by = '9' union all select 'record', id, page from rws where decision = '9' and contains({_BLOB}, 'nume1')")
def decision_sheet(spark, d):
    sheet = sheets.decision_sheet(search.index(_rows(spark, d)), tables(spark, d)[2], "9", "nume1")
    part = lambda name, df, k, n: df.select(F.lit(name).alias("part"), F.col(k).alias("k"), F.col(n).cast("long").alias("n"))
    return part("count", sheet.counts, "type", "count").unionByName(part("amends", sheet.amends, "id", "number")).unionByName(part("record", sheet.subjects, "id", "page"))


@query(f"{REG} select idnp, count(*) as records, first(name order by ord) as subject, array_to_string(list(id order by ord), ',') as ids from rws where idnp is not null group by idnp")
def identifier_lookups(spark, d):
    return publish.lookups(_rows(spark, d), AS_OF).select("idnp", F.size("records").cast("long").alias("records"), "subject", F.array_join(F.transform("records", lambda r: r["id"]), ",").alias("ids"))


@query(f"""{REG} select s.ord, concat_ws(',', s.id, name, coalesce(alias, ''), type, coalesce(cast(birth as varchar), ''), coalesce(idnp, ''), coalesce('pasaport AB' || doc, ''), case when moldova then 'Republica Moldova' else 'Ruritania' end, s.regime, cast(d.number as varchar), coalesce(cast(d.date as varchar), ''), coalesce(cast(md as varchar), ''), cast(source as varchar),
array_to_string(d.measures, '; '), case when det.id is null then '' when s.ord % 4 = 0 then 'Funcții: director general; Alte informații: x' else role end, cast(page as varchar)) as line from sub s join dec d on s.decision = d.id left join det on det.id = s.id""")
def full_csv(spark, d):
    return publish.full_lines(*tables(spark, d)).withColumn("ord", F.col("ord").cast("long"))


_TYPE_SQL = "case type when 'person' then 'Persoană' when 'entity' then 'Entitate' else 'Navă' end"
_DECISION_SQL = "'Decizia CIS nr. ' || d.number || case when d.date is null then '' else ' din ' || strftime(d.date, '%d.%m.%Y') end"
_MEASURE_SQL = "case when len(d.measures) = 2 then '\"Blocarea fondurilor și a resurselor economice; Restricții de călătorie\"' else 'Blocarea fondurilor și a resurselor economice' end"


@query(f"""{REG} select s.ord, concat_ws(',', name, coalesce(alias, ''), {_TYPE_SQL}, coalesce(cast(birth as varchar), ''), coalesce(idnp, ''), coalesce('Pașaport AB ' || doc, ''), case when moldova then 'Republica Moldova' else 'Ruritania' end, s.regime, {_DECISION_SQL}, coalesce(cast(d.date as varchar), ''), coalesce(cast(md as varchar), ''), cast(source as varchar),
{_MEASURE_SQL}, cast(page as varchar), '{BASE}#/subiect/' || s.id) as line from sub s join dec d on s.decision = d.id""")
def browser_csv(spark, d):
    s, _, dec = tables(spark, d)
    return publish.browser_lines(s, dec, BASE).withColumn("ord", F.col("ord").cast("long"))


def _batch(spark, d):
    """Identifiers, documents, whole names and strangers, by turns."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" 2001 "), F.lpad((k % 90).cast("string"), 9, "0"))).when(k % 4 == 1, F.concat(F.lit("ab"), F.lpad(((k - 1) % 60).cast("string"), 7, "0"))).when(k % 4 == 2, "Qqq Wwww; 1.2.1990").otherwise("  ")
    return search.index(_rows(spark, d)), table(spark, d, "customer").where(k < 400).select(k.cast("int").alias("row_no"), raw.alias("raw"))


_BATCH_SQL = f"""{REG}, bat as (select c_custkey as row_no, case c_custkey % 4 when 0 then '2001 ' || lpad(cast(c_custkey % 90 as varchar), 9, '0') when 1 then 'ab' || lpad(cast((c_custkey - 1) % 60 as varchar), 7, '0') else 'Qqq Wwww' end as query, case c_custkey % 4 when 0 then 'idnp' when 1 then 'document' else 'name' end as kind,
case when c_custkey % 4 = 2 then '1990-02-01' else '' end as birth, case c_custkey % 4 when 0 then (select max_by(id, ord) from rws where idnp = '2001' || lpad(cast(c_custkey % 90 as varchar), 9, '0')) when 1 then (select max_by(id, ord) from rws where doc = lpad(cast((c_custkey - 1) % 60 as varchar), 7, '0')) end as subject_id from customer where c_custkey < 400 and c_custkey % 4 <> 3)"""


@query(f"{_BATCH_SQL} select row_no, query, birth, kind, case when subject_id is null then 'none' else 'exact' end as status, subject_id from bat")
def batch_screening(spark, d):
    indexed, lines = _batch(spark, d)
    return fuzzy.screen(lines, indexed).select(F.col("row_no").cast("long").alias("row_no"), "query", "birth", "kind", "status", "subject_id")


@query(f"{_BATCH_SQL} select case when subject_id is null then 'none' else 'found' end as status, count(*) as count from bat group by 1")
def batch_tally(spark, d):
    indexed, lines = _batch(spark, d)
    return fuzzy.tally(fuzzy.screen(lines, indexed))


@query(f"""{_BATCH_SQL} select row_no, concat_ws(',', cast(row_no as varchar), query, bat.birth, case bat.kind when 'idnp' then 'IDNP' when 'document' then 'Document' else 'Nume' end, case when subject_id is null then 'Nu figurează' else 'Potrivire exactă' end, case when subject_id is null then '' else '100' end, coalesce(s.name, ''), coalesce(cast(s.b2 as varchar), ''), coalesce(s.regime, ''), coalesce({_DECISION_SQL}, ''),
coalesce('{BASE}#/subiect/' || subject_id, '')) as line from bat left join (select id, name, birth as b2, regime, decision from sub) s on s.id = subject_id left join dec d on d.id = s.decision""")
def batch_csv(spark, d):
    indexed, lines = _batch(spark, d)
    s, _, dec = tables(spark, d)
    words = {"exact": "Potrivire exactă", "strong": "Potrivire puternică", "possible": "Posibilă potrivire", "none": "Nu figurează"}
    return publish.batch_lines(fuzzy.screen(lines, indexed), s, dec, BASE, words).withColumn("row_no", F.col("row_no").cast("long"))


@query("select p_partkey, regexp_replace(p_name, ' +', ' ', 'g') as cleaned, case when length(p_name || ' ' || p_type) <= 18 then p_name || ' ' || p_type else regexp_replace(substr(p_name || ' ' || p_type, 1, 18), ' [^ ]*$', '') || '…' end as short, replace(replace(p_brand, '#', '&lt;'), 'B', '&amp;') as escaped from part")
def cleaned_texts(spark, d):
    messy = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("­ "))
    line = F.concat_ws("  ", "p_name", "p_type")
    odd = F.replace(F.replace("p_brand", F.lit("#"), F.lit("<")), F.lit("B"), F.lit("&"))
    return table(spark, d, "part").select("p_partkey", text.clean_ws(messy).alias("cleaned"), text.short(line, 18).alias("short"), text.escape_html(odd).alias("escaped"))


@query("select c_custkey, upper(lpad(to_hex(list_reduce(list_prepend(2166136261, list_transform(string_split(c_name, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0')) as hash from customer")
def receipt_numbers(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.fnv1a(F.col("c_name")).alias("hash"))


@query("""select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as day, ['ian.', 'feb.', 'mar.', 'apr.', 'mai', 'iun.', 'iul.', 'aug.', 'sep.', 'oct.', 'nov.', 'dec.'][month(o_orderdate)] || ' ' || year(o_orderdate) as month,
case when n = 1 then '1 lot' when n >= 20 and (n % 100 = 0 or n % 100 >= 20) then g || ' de loturi' else g || ' loturi' end as counted, cast(round(n % 101) as integer) as percent, round(greatest(2, log10(n + 1) / log10(20001) * 100), 6) as width, round(case when n > 0 then greatest(4, sqrt(n / 20000) * 100) else 0 end, 6) as height
from (select *, o_orderkey % 20001 as n, replace(format('{:,}', cast(o_orderkey % 20001 as bigint)), ',', '.') as g from orders)""")
def shown_labels(spark, d):
    n = F.col("o_orderkey") % 20001
    return table(spark, d, "orders").select("o_orderkey", labels.day(F.col("o_orderdate")).alias("day"), labels.month(dates.month(F.col("o_orderdate"))).alias("month"), labels.counted(n, "lot", "loturi").alias("counted"), labels.percent(n % 101 / 100).alias("percent"), F.round(labels.bars(n, F.lit(20000), log=True), 6).alias("width"), F.round(labels.heights(n, F.lit(20000)), 6).alias("height"))


@query("""select c_custkey, case c_custkey % 6 when 0 then num when 1 then null when 2 then num when 3 then num when 4 then null else num end as number from (select *, '20' || lpad(cast(c_custkey as varchar), 11, '0') as num from customer)""")
def labelled_numbers(spark, d):
    num = F.concat(F.lit("20"), F.lpad(F.col("c_custkey").cast("string"), 11, "0"))
    k = F.col("c_custkey") % 6
    said = F.when(k == 0, F.concat(F.lit("născut, IDNP: "), num)).when(k == 1, F.concat(F.lit("numărul de identificare fiscal: "), num)).when(k == 2, F.concat(F.lit("Identificare de stat - "), num))
    said = said.when(k == 3, F.concat(F.lit("Număr de identificare: 1234567890123, numărul de identificare de stat "), num)).when(k == 4, F.concat(F.lit("cod personal "), num)).otherwise(F.concat(F.lit("numar national de identificare "), num))
    return table(spark, d, "customer").select("c_custkey", extract.parse_idnp(said).alias("number"))


@query("""select c_custkey, case c_custkey % 3 when 0 then 'buletin:A:' || num when 1 then 'pasaport::' || num || ',pasaport:KX:' || n2 else 'permis:AB:' || num end as docs from (select *, lpad(cast(c_custkey as varchar), 7, '1') as num, lpad(cast(c_custkey as varchar), 8, '2') as n2 from customer)""")
def identity_documents(spark, d):
    k, num = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 7, "1")
    said = F.when(k % 3 == 0, F.concat(F.lit("Buletin de identitate seria A nr. "), num)).when(k % 3 == 1, F.concat(F.lit("pașaport: "), num, F.lit(" eliberat, KX "), F.lpad(k.cast("string"), 8, "2"))).otherwise(F.concat(F.lit("permis AB nr "), num))
    docs = extract.parse_documents(said, F.lit(None).cast("string"))
    return table(spark, d, "customer").select("c_custkey", docs.alias("x")).select("c_custkey", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["kind"], x["series"], x["number"])), ",").alias("docs"))


@query("""select o_orderkey, cast(o_orderdate as date) as local, cast(o_orderdate as date) - 30 as source, 'motive' as reason from orders""")
def listing_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    f = lambda x: F.date_format(x, "dd.MM.yyyy")
    said = F.concat(F.lit("UE – 01.01.2001 RM - "), f(F.date_sub(day, 5)), F.lit(" UE — "), f(F.date_sub(day, 30)), F.lit(" RM: "), f(day), F.lit(" RM: 31.02.2024"))
    x = extract.parse_listing(said)
    return table(spark, d, "orders").select("o_orderkey", x["md"].alias("local"), x["foreign"].alias("source"), extract.clean_reason(F.concat(F.lit("motive UE – "), f(day), F.lit(" RM - "), f(day))).alias("reason"))


@query("""select c_custkey, lower(c_mktsegment) as place, 'Moldova' as first, case when c_custkey % 2 = 0 then 3 else 2 end as n, case c_custkey % 4 when 0 then 30 when 1 then 20 when 2 then 10 else 0 end as weight from customer""")
def labelled_fields(spark, d):
    k = F.col("c_custkey")
    said = F.concat(F.lit("Data nașterii: 1.2.1980 Locul nașterii: "), F.lower("c_mktsegment"), F.lit(" Cetățenia: Moldova, Ruritania"), F.when(k % 2 == 0, " și Utopia").otherwise(""), F.lit(". Funcția: x"))
    place, field = extract.field_after(said, *subjects.FIELDS["birthPlace"]), extract.field_after(said, *subjects.FIELDS["citizenship"])
    role = F.when(k % 4 == 0, "Ministrul de x").when(k % 4 == 1, "vicepreședinte").when(k % 4 == 2, "om de afaceri").otherwise("contabil")
    nations = extract.citizenship(field)
    return table(spark, d, "customer").select("c_custkey", place.alias("place"), F.get(nations, F.lit(0)).alias("first"), F.size(nations).alias("n"), extract.role_weight(role).alias("weight"))


@query("""select p_partkey, case p_partkey % 8 when 0 then false when 1 then true when 2 then true when 3 then true when 4 then true when 5 then true when 6 then false else true end as bad, case p_partkey % 4 when 0 then 'vessel' when 1 then 'person' when 2 then 'entity' else 'person' end as type,
case p_partkey % 3 when 0 then 'entity' when 1 then 'person' end as section, case when p_partkey between 1 and 5000 then cast(p_partkey as varchar) end as number, case when p_partkey between 1 and 5000 then p_name end as rest from part where p_partkey < 10000""")
def names_and_rows(spark, d):
    k = F.col("p_partkey")
    pick = lambda given: F.get(F.array(*map(F.lit, given)), (k % len(given)).cast("int"))
    name = pick(["Ion Testescu", "exclusa din lista", "Precizare la lista", "bombe de avion", "12345", "ab", "Șantierul Nou", "Prim-ministru"])
    kind = extract.refine_type(pick(["", "entity", "", "vessel"]), pick(["Nava X", "Ana", "Firma LLC", "Y"]), pick(["IMO 1234567", "născut la 1.1.1980", "", ""]))
    section = row_rules.section_type(pick(["B. Entități juridice", "A. Persoane fizice", "Funcția de persoană"]))
    lead = row_rules.leading_number(F.concat(k.cast("string"), F.lit(". "), F.col("p_name")))
    return table(spark, d, "part").where("p_partkey < 10000").select("p_partkey", extract.is_bad_name(name).alias("bad"), kind.alias("type"), section.alias("section"), lead["number"].alias("number"), lead["rest"].alias("rest"))


@query("""select c_custkey, 'Ion Nume' || c_custkey as name, 'a: x' as info, 'Expunerea de motive: y' as reason, c_custkey % 5 + 1 as page from customer""")
def narrative_entries(spark, d):
    body = F.concat(F.lit("Ion Nume"), F.col("c_custkey").cast("string"), F.lit(", Funcția: x Expunerea de motive: y"))
    x = row_rules.narrative_fields(body)
    pages = F.concat(F.repeat(F.lit("\f"), (F.col("c_custkey") % 5).cast("int")), body)
    return table(spark, d, "customer").select("c_custkey", x["name"].alias("name"), x["info"].alias("info"), x["reason"].alias("reason"), extract.page_of(pages, body).cast("long").alias("page"))


@query("""select c_custkey, 'Ion Nume' || c_custkey as tidy, 'Precizare necesară: z' as notes, 'Ion Nume' || c_custkey as mark, 'Ion' as name, 'Funcția: x' as info, 'Ion Pop,Ivan Popov,Ваня' as forms from customer""")
def names_in_lists(spark, d):
    name = F.concat(F.lit("Ion Nume"), F.col("c_custkey").cast("string"))
    tidy = names.tidy_name(F.concat(F.lit("* "), name, F.lit(" Precizare necesară: z")), F.lit(""))
    moved = names.detach_labels(F.lit("Ion Funcția: x"), F.lit(""))
    split = names.split_aliases(F.concat(F.lit("Ion Pop alias Ivan Popov; ION POP «Ваня»"), F.substring(F.col("c_custkey").cast("string"), 1, 0)))
    # A name takes long: a small file of many is dealt to all tasks. Each value is computed once, then its parts are taken.
    made = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", tidy.alias("tidy"), moved.alias("moved"), split.alias("split"))
    tidy, moved, split = F.col("tidy"), F.col("moved"), F.col("split")
    return made.select("c_custkey", tidy["name"].alias("tidy"), tidy["notes"].alias("notes"), text.drop_footnote(F.concat(name, F.lit(" 1*"))).alias("mark"), moved["name"].alias("name"), moved["info"].alias("info"), F.concat_ws(",", split["name"], F.array_join(split["aliases"], ",")).alias("forms"))


@query("""select o_orderkey, cast(o_orderkey % 60 + 1 as integer) as number, cast(o_orderdate as date) as date, case o_orderkey % 3 when 0 then 'UK' when 1 then 'SUA' else 'UE' end as regime, 'asset_freeze' as measures, cast(o_orderdate as date) as said,
case when o_orderkey % 2 = 0 then '1980-02-01' else '' end as birth, cast(o_orderkey % 900 as integer) as by_name from orders""")
def decision_heads(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    said = F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(day) - 1), F.year(day).cast("string"))
    whose = F.when(k % 3 == 0, "Regatului Unit").when(k % 3 == 1, "Statelor Unite").otherwise("Uniunii Europene")
    head = F.concat(F.lit("DECIZIE nr. "), (k % 60 + 1).cast("string"), F.lit(" din "), said, F.lit(" Privind măsurile "), whose, F.lit(" DECIDE: blocarea fondurilor"))
    x = decisions.classify(F.lit("a/b.pdf"), head)
    birth = dates.parse_birth(F.when(k % 2 == 0, "1.2.1980").otherwise("x"))
    # All of a decision is computed once, then its parts are taken; each takes long, so the rows of few files are dealt to all tasks.
    made = spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate", x.alias("x"))
    x = F.col("x")
    return made.select("o_orderkey", x["number"].alias("number"), x["date"].alias("date"), x["regime"].alias("regime"), F.array_join(x["measures"], ",").alias("measures"), dates.parse_ro_date(said).alias("said"), birth.alias("birth"), decisions.decision_number(F.concat(F.lit("Decizia nr. "), (k % 900).cast("string"), F.lit(".pdf"))).alias("by_name"))


@query("""select n_nationkey || '-' || (c_custkey + 1) as id, cast(c_custkey + 1 as varchar) as number, 'Ion Nume' || c_custkey as name, date '1980-02-01' as birth, '20' || lpad(cast(c_custkey as varchar), 11, '0') as idnp, date '2023-05-06' as local, date '2022-03-04' as source, true as moldova, 'motive' as reason, 'pasaport:A1234567' as doc
from customer join nation on c_nationkey = n_nationkey where n_nationkey % 5 < 3 and n_nationkey % 6 <> 5 and c_custkey % 9 <> 0""")
def built_subjects(spark, d):
    k = F.col("c_custkey").cast("int")
    info = F.concat(F.lit("Data nașterii: 1.2.1980 IDNP: 20"), F.lpad(k.cast("string"), 11, "0"), F.lit(" Pașaport: A 1234567 Cetățenia: Ruritania Funcția: x"))
    name = F.when(k % 9 == 0, "Precizare la lista").otherwise(F.concat(F.lit("Ion Nume"), k.cast("string")))
    raw = table(spark, d, "customer").select(F.concat(F.lit("nr. "), F.col("c_nationkey").cast("string"), F.lit(".pdf")).alias("file"), (k + 1).alias("ord"), F.lit("").alias("listNumber"), F.lit("person").alias("type"), name.alias("name"), info.alias("info"), F.lit("motive UE – 4.3.2022 RM – 6.5.2023").alias("reason"), F.lit("").alias("notes"), F.lit(0).alias("page"))
    found, details, _ = subjects.build_subjects(raw, tables(spark, d)[2])
    doc = F.get("documents", F.lit(0))
    return found.join(details.select("id", "reason"), "id").select("id", F.col("listNumber").alias("number"), "name", F.col("birthDate").alias("birth"), "idnp", F.col("listing.md").alias("local"), F.col("listing.foreign").alias("source"), "moldova", "reason", F.concat(doc["kind"], F.lit(":"), doc["series"], doc["number"]).alias("doc"))


@query("""select 'nr. ' || n_nationkey || '.pdf' as file, c_custkey + 1 as ord, 'nume_respins_' || (c_custkey + 1) as warning from customer join nation on c_nationkey = n_nationkey where n_nationkey % 5 < 3 and n_nationkey % 6 <> 5 and c_custkey % 9 = 0""")
def rejected_names(spark, d):
    k = F.col("c_custkey").cast("int")
    name, empty = F.when(k % 9 == 0, "Precizare la lista").otherwise("Ion Testescu"), F.lit("")
    raw = table(spark, d, "customer").select(F.concat(F.lit("nr. "), F.col("c_nationkey").cast("string"), F.lit(".pdf")).alias("file"), (k + 1).alias("ord"), empty.alias("listNumber"), F.lit("person").alias("type"), name.alias("name"), *(empty.alias(x) for x in ("info", "reason", "notes")), F.lit(1).alias("page"))
    return subjects.build_subjects(raw, tables(spark, d)[2])[2].select("file", F.col("ord").cast("long").alias("ord"), "warning")


@query("""select page_id, cast(u.i as bigint) as ord, 10.0 * u.i as x0, 'w' || u.i || '&<' as text from pages, (select unnest(range(0, 3)) as i) u""")
def placed_words(spark, d):
    word = lambda i: f'<word xMin="{10 * i}.0" yMin="1.5" xMax="{10 * i + 5}.0" yMax="9.0">w{i}&amp;&lt;</word>'
    markup = f'<doc><page width="595.0" height="842.0">{word(0)}{word(1)}{word(2)}</page></doc>'
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit(markup), F.substring("url", 1, 0)).alias("markup"))
    return read.words_from_markup(pages, "page_id").select("page_id", F.col("ord").cast("long").alias("ord"), "x0", "text")
