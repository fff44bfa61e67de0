"""From records to resolved subjects, scores and statistics.

``subjects`` and ``details`` have the columns of ``sievebook.schemas``; ``ord``
is the load order and breaks every tie. ``as_of`` is the day of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, extract, text
from ..tasks import spread

#: Records of a subject whose pairs with as many others are one cell of a task.
BLOCK = 4096

# Parts of the score.
SCORES = {"moldova": 30, "regime": 25, "decision": 10, "mention": 5, "mention_cap": 40, "both": 5, "recent": 5, "recent_days": 365, "alias": 2, "alias_cap": 10}


def person_key(idnp: Column, kind: Column, name: Column, birth: Column) -> Column:
    """The identity of a subject: its number, else type, sorted folded words and birth date (J-06)."""
    sorted_name = F.array_join(F.array_sort(text.words(text.fold(name))), " ")
    return F.when(F.coalesce(idnp, F.lit("")) != "", F.concat(F.lit("idnp:"), idnp)).otherwise(F.concat_ws(":", kind, sorted_name, F.coalesce(birth.cast("string"), F.lit(""))))


def with_applied(subjects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds applied: the local listing date, or the decision's date if no record of the decision has one (D-05, J-01).

    The decisions that date their records are a distinct list, so a decision
    with most of the records is not gathered in one task.
    """
    dated = subjects.where("listing.md is not null").select(F.col("decisionId").alias("dated")).distinct()
    own = decisions.select(F.col("id").alias("decisionId"), F.col("date").alias("decisionDate"), "regime", "measures").withColumnRenamed("regime", "decisionRegime")
    own = own.join(dated, own["decisionId"] == dated["dated"], "left")
    joined = subjects.join(F.broadcast(own) if decisions.count() <= 100_000 else own, "decisionId")
    applied = F.when(F.col("listing.md").isNotNull(), F.col("listing.md")).when(F.col("dated").isNull(), F.col("decisionDate"))
    return joined.withColumn("applied", applied).drop("dated")


def mention_bigrams(subjects: DataFrame, details: DataFrame) -> DataFrame:
    """(pair, id): neighbouring canonical words of reasons, functions and notes (J-07)."""
    said = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("reason", "function", "notes")))
    words = subjects.select("id").join(details.select("id", said.alias("said")), "id").select("id", text.canon_words(F.col("said")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("w", i), F.try_element_at("w", i + 1))))
    return words.select("id", F.explode(F.array_distinct(pairs)).alias("pair"))


def name_pairs(name: Column) -> Column:
    """First and last long word of a name, in both orders (J-08)."""
    w = F.filter(text.canon_words(name), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$"))
    first, last = F.get(w, F.lit(0)), F.try_element_at(w, F.lit(-1))
    return F.when(F.size(w) >= 2, F.array_distinct(F.array(F.concat_ws(" ", first, last), F.concat_ws(" ", last, first)))).otherwise(F.array().cast("array<string>"))


def cited(subjects: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(key, cited): records of other groups that name one of the group, by pairs of one group only (J-09, J-10)."""
    names = subjects.select("key", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("variant"))
    pairs = names.select("key", F.explode(name_pairs(F.col("variant"))).alias("pair")).distinct()
    sole = pairs.groupBy("pair").agg(F.count("*").alias("owners"), F.min("key").alias("key")).where("owners = 1").select("pair", "key")
    found = sole.join(bigrams, "pair").select("key", "id").distinct()
    return found.join(subjects.select("key", "id"), ["key", "id"], "left_anti").groupBy("key").agg(F.count("*").alias("cited"))


def groups(subjects: DataFrame, details: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """One row per subject: members, head record, score and its reasons (G-01 to G-08)."""
    rows = with_applied(subjects.where("active"), decisions)
    rows = rows.withColumn("key", person_key(F.col("idnp"), F.col("type"), F.col("name"), F.col("birthDate")))
    rows = rows.join(details.select("id", "function"), "id", "left")
    number = F.coalesce(F.col("decisionId").try_cast("int"), F.lit(9999))
    rows = rows.withColumns({"number": number, "comma": F.contains("name", F.lit(",")), "role": text.clean_role(F.col("function")), "at": F.coalesce(F.col("applied").cast("string"), F.lit(""))})
    first = F.struct("comma", "number", "at", "ord")
    head = F.struct("name", "type", "aliases", "idnp", "birthDate", "citizenship")
    out = rows.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "id"))), lambda m: m["id"]).alias("ids"),
        F.min_by(head, first).alias("head"),
        F.max_by("role", F.struct(F.length("role"), -F.col("ord"))).alias("role"),
        F.array_sort(F.collect_set("regime")).alias("regimes"),
        F.transform(F.array_sort(F.collect_set(F.struct("number", "decisionId"))), lambda d: d["decisionId"]).alias("decisions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("measures")))).alias("measures"),
        F.min("applied").alias("firstApplied"), F.max("applied").alias("lastApplied"), F.bool_or("moldova").alias("moldova"),
    )
    out = out.join(cited(rows, mention_bigrams(subjects, details)), "key", "left")
    person = F.col("head.type") == "person"
    out = out.withColumn("cited", F.when(person, F.coalesce("cited", F.lit(0))).otherwise(0))
    return out.withColumns(dict(zip(("score", "why"), score(out, as_of)))).select("key", "ids", "head.*", "role", "regimes", "decisions", "measures", "moldova", "firstApplied", "lastApplied", "cited", "score", "why")


def score(g: DataFrame, as_of: str) -> tuple[Column, Column]:
    """The score of a group and its reasons in order (G-07, G-08). The alias bonus of those that are no persons has no reason."""
    s, person = SCORES, F.col("head.type") == "person"
    weight = F.when(person, extract.role_weight(F.col("role"))).otherwise(0)
    regimes, decisions = F.greatest(F.size("regimes") - 1, F.lit(0)), F.greatest(F.size("decisions") - 1, F.lit(0))
    mentions = F.least(F.lit(s["mention_cap"]), s["mention"] * F.col("cited"))
    both, late = F.size("measures") == 2, dates.recent(F.col("lastApplied"), F.lit(as_of).cast("date"), s["recent_days"])
    alias = F.when(person, 0).otherwise(F.least(F.lit(s["alias_cap"]), s["alias"] * F.size(F.coalesce(F.col("head.aliases"), F.array().cast("array<string>")))))
    total = F.when(F.col("moldova"), s["moldova"]).otherwise(0) + s["regime"] * regimes + s["decision"] * decisions + mentions + weight + F.when(both, s["both"]).otherwise(0) + F.when(late, s["recent"]).otherwise(0) + alias
    why = F.array_compact(F.array(
        F.when(F.col("moldova"), F.lit("local")), F.when(regimes > 0, F.concat((regimes + 1).cast("string"), F.lit(" regimes"))),
        F.when(decisions > 0, F.concat((decisions + 1).cast("string"), F.lit(" decisions"))), F.when(mentions > 0, F.concat(F.lit("cited by "), F.col("cited").cast("string"))),
        F.when(weight > 0, F.concat(F.lit("role "), weight.cast("string"))), F.when(both, "both measures"), F.when(late, "recent"),
    ))
    return total.cast("int"), why


def rankings(g: DataFrame) -> dict[str, DataFrame]:
    """The published slices, by score and name (O-06, O-07)."""
    by = [F.desc("score"), "name", "key"]
    person = g.where("type = 'person'")
    return {
        "relevance": person.orderBy(*by).limit(50), "international": person.where("not moldova").orderBy(*by).limit(50), "moldova": g.where("moldova").orderBy(*by),
        "regimes": g.where("size(regimes) > 1").orderBy(*by).limit(50), "entities": g.where("type = 'entity'").orderBy(*by).limit(30), "vessels": g.where("type = 'vessel'").orderBy(*by).limit(30),
    }


def latest(rows: DataFrame, n: int = 150) -> DataFrame:
    """The newest records, all keys descending (O-08)."""
    return rows.where("applied is not null").orderBy(F.desc("applied"), F.desc(F.coalesce(F.col("decisionDate").cast("string"), F.lit(""))), F.desc("name"), "ord").limit(n)


def counts(rows: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows by a key, empty keys skipped (G-09, G-13)."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias(name))


def stats(rows: DataFrame, g: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Counts by type, regime, month, measure and program, and scalars (G-09 to G-12)."""
    months = rows.where("applied is not null").groupBy(dates.month(F.col("applied")).alias("month")).agg(F.count("*").alias("count")).orderBy("month")
    force = decisions.where("status = 'in_force' and kind <> 'report'")
    return {
        "byType": counts(rows, "type"), "byRegime": counts(rows, "regime").orderBy(F.desc("count"), "regime"), "byMonth": months,
        "byMeasure": counts(rows.select(F.explode("measures").alias("measure")), "measure"),
        "byProgram": rows.groupBy("decisionId").agg(F.count("*").alias("count")).join(F.broadcast(decisions.select(F.col("id").alias("decisionId"), text.title_program(F.col("title")).alias("program"))), "decisionId").orderBy(F.desc("count"), "decisionId"),
        "scalars": rows.agg(F.count("*").alias("subjects"), F.count_distinct("key").alias("uniqueSubjects")).crossJoin(g.agg(F.count_if("moldova").alias("moldova"), F.count_if(F.size("regimes") > 1).alias("multiRegime"))).crossJoin(decisions.agg(F.count("*").alias("decisions"), F.count_if(F.col("status") == "in_force").alias("inForce"))),
        "latestDecision": force.agg(F.max_by(F.struct("id", "number", "date"), F.struct(F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("number", F.lit(0)))).alias("d")).select("d.*"),
    }


def dense_months(counted: DataFrame, start: str) -> DataFrame:
    """(bucket, count) for every month from start to the last, empty ones 0, and one row for all before (D-09)."""
    first = F.lit(start).cast("date")
    bounds = counted.agg(F.min(F.trunc("date", "month")).alias("lo"), F.max(F.trunc("date", "month")).alias("hi"))
    every = bounds.where("hi is not null").select(F.explode(F.sequence(F.greatest(first, "lo"), F.greatest(first, "hi"), F.expr("interval 1 month"))).alias("m")).select(dates.month(F.col("m")).alias("bucket"))
    found = counted.select(F.when(F.col("date") < first, "before").otherwise(dates.month(F.col("date"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("count"))
    return every.unionByName(counted.sparkSession.range(1).select(F.lit("before").alias("bucket"))).join(found, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


def siblings(rows: DataFrame) -> DataFrame:
    """(id, sibling): other records of the same subject (J-03)."""
    # Pairs grow with the square of a subject's records: these are cut to blocks, and pairs of blocks are dealt to all tasks.
    held = rows.where("key is not null and id is not null").select("key", "id", F.pmod(F.xxhash64("id"), F.ceil(F.count("*").over(Window.partitionBy("key")) / BLOCK)).alias("b"))
    held = held.groupBy("key", "b").agg(F.collect_list("id").alias("ids"))
    other = held.select("key", F.col("b").alias("c"), F.col("ids").alias("others"))
    cells = spread(held.join(other, "key"), "key", "b", "c")
    return cells.select(F.explode("ids").alias("id"), "others").select("id", F.explode("others").alias("sibling")).where("id <> sibling")


def nearest_by_number(rows: DataFrame, keys: list[str], id: str, number: str, order: str, n: int = 6) -> DataFrame:
    """(id, neighbour, place): the n rows of the same keys whose numbers are nearest; equal distances go by order, which is unique.

    They lie among the first n + 1 rows by order of a row's own number and of
    the n numbers before and after it, so no pairs of a whole group are formed.
    Null keys are equal; rows without number have no part.
    """
    rows = rows.where(F.col(number).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(number).alias("_nr"), F.col(order).alias("_ord"), F.col(id).alias("_id"))
    place = F.row_number().over(Window.partitionBy("_k", "_nr").orderBy("_ord"))
    # The first n + 1 of each number, so that a number with most of the rows is not gathered.
    first = rows.withColumn("_p", place).where(F.col("_p") <= n + 1)
    numbers = first.groupBy("_k", "_nr").agg(F.array_sort(F.collect_list(F.struct("_ord", "_id"))).alias("_held"))
    w = Window.partitionBy("_k").orderBy("_nr")
    steps = [f("_nr", k).over(w) for k in range(1, n + 1) for f in (F.lag, F.lead)]
    near = numbers.withColumn("_others", F.array_compact(F.array("_nr", *steps))).select("_k", "_nr", F.explode("_others").alias("_other"))
    held = near.join(numbers.select("_k", F.col("_nr").alias("_other"), "_held"), ["_k", "_other"]).select("_k", "_nr", F.abs(F.col("_nr") - F.col("_other")).alias("_far"), F.explode("_held").alias("_o"))
    # Of each number the n + 1 nearest, one of which may be the row itself.
    nearest = held.groupBy("_k", "_nr").agg(F.slice(F.array_sort(F.collect_list(F.struct("_far", "_o"))), 1, n + 1).alias("_near"))
    others = rows.join(nearest, ["_k", "_nr"]).select("_id", F.slice(F.filter("_near", lambda x: x["_o"]["_id"] != F.col("_id")), 1, n).alias("_near"))
    return others.select(F.col("_id").alias("id"), F.posexplode("_near").alias("place", "o")).select("id", F.col("o._o._id").alias("neighbour"), (F.col("place") + 1).alias("place"))


def neighbours(rows: DataFrame, n: int = 6) -> DataFrame:
    """(id, neighbour, place): nearest list numbers of the same decision and type, of equal distances the smaller ord (O-11)."""
    return nearest_by_number(rows.withColumn("nr", F.col("listNumber").try_cast("int").cast("long")), ["decisionId", "type"], "id", "nr", "ord", n)
