"""Cards: what the tables of an export tell at a glance, for all tables in one job.

Tables come as cells. Their columns are profiled, a column is chosen for each role that a card needs (date,
measure, money, currency, rank, label, key, value), and only the cells in a role are put together to
rows again, once. Each kind of card is an aggregate over those rows; what a card shows (bars, points,
years, facts, things) are rows of a second table, so nothing grows inside a card.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import dates, names, numbers, units
from keepsake.tables import stash

from . import profile, series

#: Names of columns that hold keys, values, currencies; that are no measure, or are one in any table.
KEY_COLUMN, VALUE_COLUMN, CURRENCY_COLUMN = "(?i)^key$|^field$|^name$|^attribute$", "(?i)^value$|^text ?value$|^data$", "(?i)currency|curr[_ ]?code"
NO_MEASURE, PLAIN, COUNT = r"(?i)offset|index|_?id$|count$|type$|version|flag|zone|order", "(?i)^(value|amount|total|score|level|duration)$", "(?i)^count$"
#: What names tell about a label, with their points; keys of a JSON cell that name what it is about.
LABEL_WORDS = (("(?i)title|subject|caption", 6), (r"(?i)\bname\b", 2), ("(?i)app|content|item|product|label|note|activity", 4))
NAME_KEY = "path|title|name|subject|filename|file|label|caption"
#: Rows of a table of keys and values, facts shown, bars, points, things in a list; longest label; the hours from which sleep is in minutes.
FACT_ROWS, FACTS, BARS, POINTS, THINGS, LONGEST, MOST_HOURS = 60, 24, 8, 60, 60, 90, 24
ROLES = ("date", "measure", "money", "currency", "rank", "label", "key", "val")

CARD = "kind string, title string, subtitle string, unit string, stat double, stat_label string, low double, high double, n long, rows long, currency string, chart boolean, since timestamp_ntz, until timestamp_ntz"
ITEM = "kind string, place int, label string, value double, text string, at timestamp_ntz, n long, low double, high double"


def unwrap(value: Column) -> Column:
    """A cell as a label: trimmed; of a JSON document the name in it, without folders and ending, empty if
    there is none. A name among its own keys counts before the first one deeper in the text."""
    s = F.trim(value)
    top = F.map_values(F.map_filter(F.try_variant_get(F.try_parse_json(s), "$", "map<string,variant>"), lambda k, v: k.rlike(f"(?i)^({NAME_KEY})$") & (F.trim(F.try_variant_get(v, F.lit("$"), "string")) != "") & F.schema_of_variant(v).isin("STRING")))
    deep = F.nullif(F.regexp_extract(s, rf'(?i)"(?:{NAME_KEY})"\s*:\s*"([^"]*[^"\s][^"]*)"', 1), F.lit(""))
    named = F.when(F.try_parse_json(s).isNotNull(), F.coalesce(F.try_variant_get(F.get(top, F.lit(0)), F.lit("$"), "string"), deep))
    base = F.trim(F.regexp_replace(F.regexp_extract(F.regexp_replace(named, r"[/\\]+$", ""), r"([^/\\]*)$", 1), r"(?i)\.[a-z0-9]{1,5}$", ""))
    return F.when(s.rlike(r"^[{\[]"), F.coalesce(base, F.lit(""))).otherwise(s)


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def chosen_columns(prof: DataFrame, labels: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """A row a table: tables with the number of the column in each role, or null.

    prof: column_profile; labels(by, col_no, good, junk): cells that make labels, and of those the
    ones that are too long or still JSON; tables(by, title, rule, n_rows)."""
    c = prof.join(labels, [*by, "col_no"], "left").join(tables, by)
    name, kind, rule, rows = F.col("col_name"), F.col("type"), F.col("rule"), F.col("n_rows")
    number, noise = kind == "number", name.rlike(profile.NOISE)
    usable = number & ~name.rlike(NO_MEASURE)
    plain = F.trim(name).rlike(PLAIN)
    ruled = rule.isNotNull()
    want = _plain(units.rule(rule, "label"))
    wishes = [
        usable & ruled & (_plain(name) == want), usable & ruled & F.contains(_plain(name), want), usable & ruled & plain, usable & units.rule_fits(rule, name), usable & ruled & (_plain(name) == _plain(F.col("title"))),
        usable & plain, number & F.trim(name).rlike(COUNT), usable & ruled,
    ]
    wish = F.coalesce(*(F.when(w, F.lit(i)) for i, w in enumerate(wishes)))
    good, span = F.coalesce("good", F.lit(0)), F.greatest(F.lit(1), F.least(rows, F.lit(400)))
    words = F
    for pattern, points in LABEL_WORDS:
        words = words.when(name.rlike(pattern), F.lit(float(points)))
    points = words.otherwise(0.0) + (kind == "title").cast("int") * 2 + (kind == "url").cast("int") + F.least(F.lit(4.0), F.col("distinct") / span * 4) - (F.col("distinct") == 1).cast("int") * 6
    names_ = ~kind.isin("id", "date", "empty") & ~noise & (good * 2 >= rows) & (good > 0) & (F.col("junk") <= good * 0.3) & (points > 0)
    at = F.col("col_no")
    first = lambda cond: F.min(F.when(cond, at))
    return c.groupBy(*by, "title", "rule", "n_rows").agg(
        first(kind == "date").alias("date"), F.min_by(at, F.when(wish.isNotNull(), F.struct(wish, at))).alias("measure"), first(kind == "money").alias("money"), first(name.rlike(CURRENCY_COLUMN)).alias("currency"),
        F.when(F.first("n_rows") >= 4, first((kind == "category") & (F.col("distinct") >= 3))).alias("rank"), F.max_by(at, F.when(names_, F.struct(points, -at))).alias("label"), first(name.rlike(KEY_COLUMN)).alias("key"), first(name.rlike(VALUE_COLUMN)).alias("val"),
        F.min_by("col_name", F.when((kind == "category") & (F.col("distinct") >= 3), at)).alias("rank_name"), F.count(F.lit(1)).alias("n_cols"),
    )


def cards(cells: DataFrame, titles: DataFrame, by: tuple[str, ...] = ("table_id",), now_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards, items) of cells(by, row_no, col_no, col_name, value) and titles(by, title).

    cards: by, kind, title, subtitle, unit, stat, stat_label, low, high, n, rows, currency, chart, since,
    until, score. A table of keys and values, or of one row, is a card of facts and nothing else;
    otherwise it has a series, a total of money and a ranking, as far as it has the columns; without
    any of those it is a list, or a count. Two tables or more that are only counts become one card
    `other`, without a table. items: what cards show, numbered within their card. A table without
    rows has no card. Types go by all cells."""
    keys = list(by)
    prof = stash(profile.column_profile(cells.select(*keys, "col_no", "col_name", "value"), now_ms, by), "profile")
    label = unwrap(F.col("value"))
    junk = label.rlike(r"^[{\[]") | (F.length(label) > LONGEST)
    told = cells.groupBy(*keys, "col_no").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(label != "", 1)).alias("good"), F.count(F.when((label != "") & junk, 1)).alias("junk"))
    told = stash(told, "labels")
    sizes = told.groupBy(*keys).agg(F.max("all").alias("n_rows"))
    tables = titles.select(*keys, "title").join(sizes, keys).withColumn("rule", units.rule_of(F.col("title")))
    plan = stash(chosen_columns(prof, told.drop("all"), tables, keys), "plan")
    roles = plan.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, ROLES)), F.array(*ROLES))).alias("role", "col_no")).where("col_no IS NOT NULL")
    held = cells.select(*keys, "row_no", "col_no", "value").join(roles, [*keys, "col_no"])
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("value")))
    wide = held.groupBy(*keys, "row_no").agg(*(of(r).alias(r) for r in ROLES))
    number = lambda c: numbers.to_number(F.col(c))
    rows = wide.select(
        *keys, "row_no", dates.profile_date(F.col("date"), now_ms).alias("at"), number("measure").alias("measure"), number("money").alias("money"), F.nullif(F.trim("currency"), F.lit("")).alias("currency"),
        F.nullif(F.trim("rank"), F.lit("")).alias("rank"), F.nullif(unwrap(F.col("label")), F.lit("")).alias("label"), F.trim("key").alias("key"), F.trim("val").alias("val"),
    )
    rows = stash(rows, "rows")
    span = rows.groupBy(*keys).agg(F.min("at").alias("since"), F.max("at").alias("until"))
    plan = stash(plan.join(span, keys, "left"), "plan")

    facts = stash(_facts(cells, rows, plan, keys), "facts")
    shown = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(plan, keys)
    rest = plan.join(shown.select(*keys), keys, "left_anti")
    open_ = rows.join(rest.select(*keys), keys, "left_semi")
    made = [_card(shown, keys, "facts"), *(f(open_, rest, keys) for f in (_series, _money, _rank))]
    some = stash(reduce(DataFrame.unionByName, made), "cards")
    bare = rest.join(some.select(*keys), keys, "left_anti")
    things = open_.where("label IS NOT NULL").join(bare.select(*keys), keys, "left_semi")
    listed = stash(_card(things.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(bare, keys), keys, "list"), "lists")
    thin = stash(_card(bare.join(listed.select(*keys), keys, "left_anti").withColumn("n", F.lit(1).cast("long")), keys, "count", stat=F.col("n_rows").cast("double"), stat_label=F.when(F.col("n_rows") == 1, "record").otherwise("records")), "thin")
    several = thin.agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") > 1).alias("_fold"))
    fold = several.where("_fold")
    other = _card(fold.withColumns({k: F.lit(None).cast(dict(cells.dtypes)[k]) for k in keys}).withColumns({"title": F.lit("Also in this export"), "n_rows": F.col("n"), "since": F.lit(None).cast("timestamp_ntz"), "until": F.lit(None).cast("timestamp_ntz")}), keys, "other")
    alone = thin.join(F.broadcast(several.where("NOT _fold").select("_fold")))  # one row or none
    every = some.unionByName(listed).unionByName(alone.select(*some.columns)).unionByName(other)
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(w))) for k, w in [*profile.WEIGHTS.items(), ("other", 1)]))
    scored = every.withColumn("score", weight + F.least(F.lit(30.0), F.log10(F.greatest(F.lit(1), F.col("n")).cast("double")) * 12))

    items = [_shown_facts(facts, keys), _points(open_, some, keys), _years(open_, some, keys), _bars(open_, some, keys), _things(things, keys)]
    folded = thin.join(F.broadcast(fold.select("_fold"))).select(*keys, F.lit("other").alias("kind"), F.lit(None).cast("int").alias("place"), F.col("title").alias("label"), "stat", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("rows").alias("n"))  # one row or none
    items.append(_items(folded, keys, value=F.col("stat")))
    return scored, reduce(DataFrame.unionByName, items)


def _typed(name: str, ddl: str) -> str:
    return dict(part.strip().split(" ") for part in ddl.split(","))[name]


def _card(rows: DataFrame, keys: list[str], kind: str, **values: Column) -> DataFrame:
    """rows(keys, title, n, n_rows, since, until) as cards of a kind; what values doesn't name is null."""
    given = {"kind": F.lit(kind), "title": F.col("title"), "n": F.col("n"), "rows": F.col("n_rows"), "since": F.col("since"), "until": F.col("until")} | values
    return rows.select(*keys, *(given.get(c, F.lit(None)).cast(_typed(c, CARD)).alias(c) for c in (p.strip().split(" ")[0] for p in CARD.split(","))))


def _items(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    have = {c: F.col(c) for c in rows.columns} | values
    return rows.select(*keys, *(have.get(c, F.lit(None)).cast(_typed(c, ITEM)).alias(c) for c in (p.strip().split(" ")[0] for p in ITEM.split(","))))


def _facts(cells: DataFrame, rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, label, text): of tables of keys and values, and of tables of one row with two facts or more."""
    pairs = plan.where((F.col("n_rows") <= FACT_ROWS) & F.col("key").isNotNull() & F.col("val").isNotNull()).select(*keys)
    listed = rows.join(pairs, keys, "left_semi").where((F.col("key") != "") & (F.col("val") != "") & ~F.col("key").rlike(profile.NOISE)).select(*keys, F.col("row_no").cast("long").alias("place"), F.col("key").alias("k"), F.col("val").alias("v"))
    single = plan.where("n_rows = 1 AND n_cols > 2").join(listed.select(*keys).distinct(), keys, "left_anti").select(*keys)
    name = F.col("col_name")
    own = cells.join(single, keys, "left_semi").where((F.trim("value") != "") & ~name.rlike(profile.ID_WORDS) & ~name.rlike(profile.NOISE)).select(*keys, F.col("col_no").cast("long").alias("place"), name.alias("k"), F.trim("value").alias("v"))
    enough = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*keys)
    every = listed.unionByName(own.join(enough, keys, "left_semi"))
    return every.select(*keys, "place", names.nice_key(F.col("k")).alias("label"), names.nice_value(F.col("k"), F.col("v")).alias("text"))


def _shown_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    return _items(facts.withColumn("_r", place).where(F.col("_r") <= FACTS), keys, kind=F.lit("facts"), place=F.col("_r"))


def _series(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("measure")
    last = F.max_by(v, F.struct("at", "row_no"))
    got = rows.where("at IS NOT NULL AND measure IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), numbers.total(v).alias("sum"), F.min(v).alias("low"), F.max(v).alias("high"), last.alias("last")).where("n >= 2").join(plan, keys)
    rule = F.col("rule")
    agg, mean = F.coalesce(units.rule(rule, "agg"), F.lit("mean")), F.col("sum") / F.col("n")
    unit = F.coalesce(units.rule(rule, "unit"), F.lit(""))
    stat = F.when(agg == "sum", F.col("sum")).when(agg == "last", F.col("last")).when(agg == "count", F.col("n")).otherwise(mean)
    name = F.when(agg == "sum", "total").when(agg == "last", "latest").when(agg == "count", "records").otherwise("average")
    return _card(
        got, keys, "series", title=F.coalesce(units.rule(rule, "label"), F.col("title")), unit=F.when((unit == "h") & (mean > MOST_HOURS), "min").otherwise(unit), stat=stat, stat_label=name, low=F.col("low"), high=F.col("high"),
        chart=(F.col("n") >= 4) & (F.col("low") != F.col("high")),
    )


def _points(rows: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    own = made.where("kind = 'series'").select(*keys)
    points = rows.where("at IS NOT NULL AND measure IS NOT NULL").join(own, keys, "left_semi").select(F.struct(*keys).alias("series"), F.unix_micros(F.col("at").cast("timestamp")).alias("t"), F.col("measure").alias("v"))
    got = series.time_buckets(points, POINTS)
    place = F.row_number().over(Window.partitionBy("series").orderBy("t", "bucket"))
    return _items(got.withColumn("place", place).select("series.*", "place", F.col("v").alias("value"), F.timestamp_micros("t").cast("timestamp_ntz").alias("at"), "n", F.col("lo").alias("low"), F.col("hi").alias("high")), keys, kind=F.lit("series"))


def _unit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per table with positive amounts: their sum, greatest and number, the one currency, and what an amount is
    divided by: whole amounts from 10,000 on beside one currency code are millionths."""
    spent = F.when(F.col("money") > 0, F.col("money"))
    got = rows.groupBy(*keys).agg(
        numbers.total(spent).alias("sum"), F.max(spent).alias("most"), F.min(spent).alias("least"), F.count(spent).alias("n"), F.bool_and(spent == F.floor(spent)).alias("whole"), F.min("currency").alias("c0"), F.max("currency").alias("c1")
    ).where("n > 0")
    one = F.when(F.col("c0") == F.col("c1"), F.col("c0"))
    return got.select(*keys, "sum", "most", "n", one.alias("currency"), F.when(one.isNotNull() & F.col("whole") & (F.col("least") >= 10_000), 1e6).otherwise(1.0).alias("scale"))


def _money(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    got = _unit(rows, keys).join(plan.drop("currency"), keys)
    return _card(got, keys, "money", stat=F.col("sum") / F.col("scale"), stat_label=F.lit("total"), high=F.col("most") / F.col("scale"), currency=F.col("currency"))


def _years(rows: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    own = rows.join(made.where("kind = 'money'").select(*keys), keys, "left_semi")
    got = own.where("at IS NOT NULL AND money > 0").groupBy(*keys, F.year("at").alias("year")).agg(numbers.total(F.col("money")).alias("s"), F.count(F.lit(1)).alias("n")).join(_unit(own, keys).select(*keys, "scale"), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("year"))
    return _items(got.withColumn("place", place), keys, kind=F.lit("money"), label=F.col("year").cast("string"), value=F.col("s") / F.col("scale"))


def _tallied(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where("rank IS NOT NULL").groupBy(*keys, "rank").agg(F.count(F.lit(1)).alias("n"))


def _rank(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    got = _tallied(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("bars")).where("bars >= 3").join(plan, keys)
    return _card(got.withColumn("n", F.col("n_rows")), keys, "rank", subtitle=F.concat(F.lit("By "), F.lower("rank_name")))


def _bars(rows: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "rank"))
    got = _tallied(rows.join(made.where("kind = 'rank'").select(*keys), keys, "left_semi"), keys).withColumn("place", place).where(F.col("place") <= BARS)
    return _items(got, keys, kind=F.lit("rank"), label=F.col("rank"))


def _things(things: DataFrame, keys: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("at"), "row_no"))
    return _items(things.select(*keys, "label", "at", place.alias("place")).where(F.col("place") <= THINGS), keys, kind=F.lit("list"))
