"""Panel completeness (CM-14..25, JN-2, 3, 5) and vintages (VR-*, JN-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.quantiles import percentiles
from plumbline.functions.values import parse_period, period_key, period_ordinal, rounded
from plumbline.plans.registry import query
from plumbline.session import table

FLOOR = 0.95


def prepared(df: DataFrame, entity: str, period: str, grain: str) -> DataFrame:
    """`df` with entity_key (trimmed), ordinal, and invalid: why a row has no key (CM-14)."""
    e, o = F.trim(F.col(entity).cast("string")), parse_period(F.col(period), grain)
    invalid = F.when(F.col(entity).isNull() | (e == ""), "blank entity").when(F.col(period).isNull(), "blank period").when(o.isNull(), "bad period")
    return df.withColumns({"entity_key": e, "ordinal": o, "invalid": invalid})


def invalid_rows(rows: DataFrame) -> DataFrame:
    return rows.where("invalid is not null").groupBy("invalid").agg(F.count("*").alias("rows"))


def calendar_gaps(rows: DataFrame, grain: str) -> DataFrame:
    """Periods between the first and the last that no row has (CM-15)."""
    seen = rows.where("invalid is null").select("ordinal").distinct()
    ends = seen.agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("ordinal")).join(seen, "ordinal", "left_anti").select("ordinal", period_key(F.col("ordinal"), grain).alias("period"))


def spans(rows: DataFrame) -> DataFrame:
    """First and last period of each entity (a, b) and the number of periods that it was seen in."""
    return received(rows).groupBy("entity_key").agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count("*").alias("seen"))


def required(spans_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many entities' spans cover each period, by group: one more from a start on, one less after an end, summed in the
    order of periods (CM-16, trap of the full grid). No row an entity and period is made, so a wild date costs nothing."""
    by = by or []
    steps = F.explode(F.array(F.struct(F.col("a").alias("ordinal"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("ordinal"), F.lit(-1).alias("step")))).alias("r")
    per = spans_.select(*by, steps).groupBy(*by, "r.ordinal").agg(F.sum("r.step").alias("step"))
    order = Window.partitionBy(*by).orderBy("ordinal")  # one row a period
    open_ = per.withColumns({"required": F.sum("step").over(order), "until": F.lead("ordinal").over(order) - 1}).where("required > 0")
    return open_.select(*by, F.explode(F.sequence("ordinal", "until")).alias("ordinal"), "required")


def received(rows: DataFrame) -> DataFrame:
    return rows.where("invalid is null").select("entity_key", "ordinal").distinct()


def covered(need: DataFrame, got: DataFrame, by: list[str], grain: str) -> DataFrame:
    """Required and received numbers side by side, with the share and the period's label."""
    both = need.join(got.groupBy(*by).agg(F.count("*").alias("received")), by, "left").withColumn("received", F.coalesce("received", F.lit(0)))
    return both.withColumns({"period": period_key(F.col("ordinal"), grain), "coverage": F.col("received") / F.col("required")})


def period_coverage(rows: DataFrame, grain: str, floor: float = FLOOR) -> DataFrame:
    """Required, received, coverage and verdict of each period (CM-16)."""
    return covered(required(spans(rows)), received(rows), ["ordinal"], grain).withColumn("passed", F.col("coverage") >= floor)


def missing_pairs(rows: DataFrame) -> DataFrame:
    """Required entity-period pairs that were not received: the periods between two neighbouring ones (JN-2)."""
    before = F.lag("ordinal").over(Window.partitionBy("entity_key").orderBy("ordinal"))
    gaps = received(rows).withColumn("before", before).where("ordinal > before + 1")
    return gaps.select("entity_key", F.explode(F.sequence(F.col("before") + 1, F.col("ordinal") - 1)).alias("ordinal"))


def continuity(rows: DataFrame) -> DataFrame:
    """Portfolio coverage, missing pairs, entities and periods with gaps (CM-18)."""
    own, zero = spans(rows), F.lit(0)
    length = F.col("b").cast("long") - F.col("a") + 1
    entities = own.agg(F.coalesce(F.sum(length), zero).alias("required"), F.coalesce(F.sum("seen"), zero).alias("received"), F.count_if(F.col("seen") < length).alias("entities_with_gaps"))
    periods = covered(required(own), received(rows), ["ordinal"], "month").agg(F.count_if(F.col("received") < F.col("required")).alias("periods_with_gaps"))
    one = entities.crossJoin(F.broadcast(periods))  # one row beside one row
    return one.withColumns({"missing": F.col("required") - F.col("received"), "coverage": F.col("received") / F.nullif(F.col("required"), zero)})


def duplicates(rows: DataFrame, values: list[str]) -> DataFrame:
    """Entity-period pairs with several rows: exact if all agree on `values`, else conflicting; surplus rows (CM-17)."""
    per = rows.where("invalid is null").groupBy("entity_key", "ordinal").agg(F.count("*").alias("rows"), F.count_distinct(F.sha2(F.to_json(F.struct(*values)), 256)).alias("kinds")).where(F.col("rows") > 1)
    kind = F.when(F.col("kinds") == 1, "exact").otherwise("conflicting")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("pairs"), F.sum(F.col("rows") - 1).alias("surplus"), F.max("rows").alias("max_rows"))


def segment_cells(rows: DataFrame, segment: str, grain: str) -> DataFrame:
    """Coverage per segment and period over the entities whose segment never changes (CM-19)."""
    valid = rows.where("invalid is null")
    stable = valid.groupBy("entity_key").agg(F.min(segment).alias("segment"), F.max(segment).alias("other"), F.count_if(F.col(segment).isNull()).alias("nulls"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).where("segment = other and nulls = 0")
    got = valid.groupBy("entity_key", "ordinal").agg(F.min(segment).alias("segment")).join(stable.select("entity_key"), "entity_key", "left_semi")
    return covered(required(stable, ["segment"]), got, ["segment", "ordinal"], grain)


def peer_coverage(cells: DataFrame) -> DataFrame:
    """Each cell's coverage beside the median of its period (CM-23, JN-5); medians by rank, so no task holds a period's cells."""
    medians = percentiles(cells, {"coverage": F.col("coverage")}, [0.5], ["ordinal"]).select(F.col("ordinal").alias("_at"), F.col("q")[0].alias("peer_median"))
    return cells.join(medians, F.col("ordinal").eqNullSafe(F.col("_at")), "left").drop("_at")


def windowed_grid(rows: DataFrame, origination: str, grain: str = "month") -> DataFrame:
    """Per entity: start = the later of origination and first row, interior gaps, and rows before origination (CM-21)."""
    o = period_ordinal(F.col(origination), grain)
    per = rows.where("invalid is null").groupBy("entity_key").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("seen"), F.min(o).alias("origin"))
    return per.select("entity_key", F.greatest("first", "origin").alias("start"), "last", (F.col("last") - F.col("first") + 1 - F.col("seen")).alias("interior_gaps"), F.coalesce(F.col("first") < F.col("origin"), F.lit(False)).alias("contradiction"))


def identifier_hygiene(df: DataFrame, key: str) -> DataFrame:
    """Blank keys and keys that differ only in case or white space (CM-24)."""
    return df.agg(F.count_if(F.col(key).isNull() | (F.trim(key) == "")).alias("blanks"), (F.count_distinct(key) - F.count_distinct(F.lower(F.trim(key)))).alias("collisions"))


def granularity(df: DataFrame, date: str) -> DataFrame:
    """The modal gap in months between distinct months and its share; confirmed from 0.8 (CM-25)."""
    months = df.where(F.col(date).isNotNull()).select(period_ordinal(F.col(date), "month").alias("m")).distinct()  # months, not rows
    gaps = months.select((F.col("m") - F.lag("m").over(Window.partitionBy().orderBy("m"))).alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))
    best = gaps.agg(F.min_by("gap", F.struct(-F.col("n"), "gap")).alias("modal_gap"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.select("modal_gap", (F.col("n") / F.col("all")).alias("share"), (F.col("n") / F.col("all") >= 0.8).alias("confirmed"))


def cases(df: DataFrame, entity: str, anchor: str, status: str, at: str) -> DataFrame:
    """One row a case (entity, anchor): last status, last observation, length in days (VR-1)."""
    per = df.groupBy(F.col(entity).alias("entity"), F.col(anchor).alias("anchor")).agg(F.max_by(status, F.struct(at, status)).alias("last_status"), F.max(at).alias("last_at"))
    return per.withColumns({"vintage": F.year("anchor"), "days": F.datediff("last_at", "anchor")})


def mature(cases_: DataFrame, as_of: str, months: int) -> DataFrame:
    """Cases of vintages whose December lies at least `months` before the date (VR-2)."""
    gap = F.year(F.lit(as_of).cast("date")) * 12 + F.month(F.lit(as_of).cast("date")) - (F.col("vintage") * 12 + 12)
    return cases_.where(gap >= months)


def resolution(cases_: DataFrame, finished: list[str], by: list[str], floor: float = 0.9, least: int = 5) -> DataFrame:
    """Share of finished cases per vintage (or vintage and segment) against a floor (VR-3, VR-9)."""
    per = cases_.groupBy(*by).agg(F.count("*").alias("cases"), F.avg(F.col("last_status").isin(finished).cast("int")).alias("rate"))
    return per.withColumn("verdict", F.when(F.col("cases") < least, "TOO-FEW").when(F.col("rate") >= floor, "PASS").otherwise("VIOLATION"))


def loss_by_vintage(cases_: DataFrame, loss: str, finished: list[str], tolerance: float = 0.1) -> DataFrame:
    """Mean and median loss, stamped CENSORED where too many cases are open (VR-4)."""
    open_ = F.avg((~F.col("last_status").isin(finished)).cast("int"))
    per = cases_.groupBy("vintage").agg(F.avg(loss).alias("mean"), open_.alias("open_share"))
    return with_median(per, cases_, "vintage", loss, "median").withColumn("stamp", F.when(F.col("open_share") > tolerance, "CENSORED"))


def with_median(per: DataFrame, rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """`per`, one row a group, with the exact median of `value` over the group's rows."""
    medians = percentiles(rows, {value: F.col(value)}, [0.5], [by]).select(F.col(by).alias("_by"), F.col("q")[0].alias(name))
    return per.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def mix_gap(cases_: DataFrame, flag: str) -> DataFrame:
    """Each vintage's share of `flag` less the pooled share (VR-5)."""
    per = cases_.groupBy("vintage").agg(F.count("*").alias("cases"), F.sum(F.col(flag).cast("int")).alias("hits"))
    pooled = F.sum("hits").over(Window.partitionBy()) / F.sum("cases").over(Window.partitionBy())  # one row a vintage
    return per.withColumn("gap", F.col("hits") / F.col("cases") - pooled)


def stale_open(cases_: DataFrame, finished: list[str], as_of: str, months: int, times: float = 1.5) -> DataFrame:
    """Open cases older than `times` horizons (VR-6)."""
    age = F.datediff(F.lit(as_of).cast("date"), "anchor") / 30.44
    return cases_.where(~F.col("last_status").isin(finished) & (age > months * times))


def median_gap(cases_: DataFrame, value: str) -> DataFrame:
    """Each vintage's median less the pooled median (VR-8)."""
    pooled = percentiles(cases_, {value: F.col(value)}, [0.5]).agg(F.max(F.col("q")[0]).alias("pooled"))
    per = with_median(cases_.select("vintage").distinct(), cases_, "vintage", value, "median")
    return per.crossJoin(F.broadcast(pooled)).withColumn("gap", F.col("median") - F.col("pooled"))  # one row beside each


def later_event(cured: DataFrame, events: DataFrame, entity: str, at: str, months: int) -> DataFrame:
    """Rows of `cured` (entity, at) followed within `months` by an event of the same entity: an interval semi join (VR-10,
    JN-6). Rows meet events by entity and stretch of `months` months, an event in its own stretch and the one before, so a
    busy entity is spread over its stretches."""
    def stretch(c):
        return F.floor((F.year(c) * 12 + F.month(c)) / max(months, 1))

    e = events.select(F.col(entity).alias("_e"), F.col(at).alias("_at")).distinct().withColumn("_s", F.explode(F.array(stretch("_at"), stretch("_at") - 1)))
    near = (F.col(entity) == F.col("_e")) & (stretch(at) == F.col("_s")) & (F.col("_at") > F.col(at)) & (F.col("_at") <= F.add_months(F.col(at), months))
    return cured.join(e, near, "left_semi")


def longest_segment(df: DataFrame, entity: str, segment: str, date: str, least: int = 20) -> DataFrame:
    """The segment with the longest median observation, among those with enough entities (VR-11)."""
    own = df.groupBy(entity, F.col(segment).alias("segment")).agg(F.datediff(F.max(date), F.min(date)).alias("days"))
    per = with_median(own.groupBy("segment").agg(F.count("*").alias("entities")), own, "segment", "days", "median_days")
    return per.where(F.col("entities") >= least).agg(F.max_by("segment", F.struct("median_days", "segment")).alias("segment"), F.max("median_days").alias("median_days"))


def guards(df: DataFrame, required_: list[str], date: str, as_of: str) -> DataFrame:
    """Shared preconditions: columns present, rows after the as-of date (VR-12)."""
    absent = sorted(set(required_) - set(df.columns))
    late = F.count_if(F.col(date) > F.lit(as_of).cast("timestamp")) if date in df.columns else F.lit(0).cast("long")
    return df.agg(late.alias("rows_after_as_of"), F.count("*").alias("rows")).withColumns({"absent": F.lit(", ".join(absent)), "passed": F.lit(not absent) & (F.col("rows_after_as_of") == 0) & (F.col("rows") > 0)})


def orders_panel(spark, sf_dir, grain: str = "quarter"):
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return prepared(o, "o_custkey", "day", grain)


_PANEL = """WITH p AS (SELECT o_custkey::VARCHAR AS e, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS o, * FROM orders),
 rec AS (SELECT DISTINCT e, o FROM p), req AS (SELECT e, unnest(range(min(o), max(o) + 1)) AS o FROM p GROUP BY e),
 both_ AS (SELECT req.e, req.o, rec.e IS NOT NULL AS got FROM req LEFT JOIN rec ON rec.e = req.e AND rec.o = req.o)"""


@query("panel_period_coverage", f"""{_PANEL} SELECT o::INT AS ordinal, count(*) AS required, count(*) FILTER (WHERE got) AS received, (o // 4) || '-Q' || (o % 4 + 1) AS period, round(avg(got::INT), 6) AS coverage, avg(got::INT) >= 0.95 AS passed FROM both_ GROUP BY o""")
def panel_period_coverage(spark, sf_dir):
    return period_coverage(orders_panel(spark, sf_dir), "quarter").withColumn("coverage", rounded(F.col("coverage")))


@query("panel_missing_pairs", f"{_PANEL} SELECT e AS entity_key, o::INT AS ordinal FROM both_ WHERE NOT got")
def panel_missing_pairs(spark, sf_dir):
    return missing_pairs(orders_panel(spark, sf_dir))


@query("panel_continuity", f"""{_PANEL} SELECT count(*) AS required, count(*) FILTER (WHERE got) AS received, count(DISTINCT e) FILTER (WHERE NOT got) AS entities_with_gaps, count(DISTINCT o) FILTER (WHERE NOT got) AS periods_with_gaps, count(*) FILTER (WHERE NOT got) AS missing, round(avg(got::INT), 6) AS coverage FROM both_""")
def panel_continuity(spark, sf_dir):
    return continuity(orders_panel(spark, sf_dir)).withColumn("coverage", rounded(F.col("coverage")))


@query("panel_calendar_gaps", """WITH m AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS o FROM orders WHERE o_totalprice > 490000) SELECT g.o::INT AS ordinal, (g.o // 12) || '-' || lpad((g.o % 12 + 1)::VARCHAR, 2, '0') AS period FROM (SELECT unnest(range(min(o), max(o) + 1)) AS o FROM m) g ANTI JOIN m ON m.o = g.o""")
def panel_calendar_gaps(spark, sf_dir):
    """Months without a very large order; all other orders are rows without a period."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.when(F.col("o_totalprice") > 490000, F.date_format("o_orderdate", "yyyy-MM-dd")))
    return calendar_gaps(prepared(o, "o_custkey", "day", "month"), "month")


@query("panel_duplicates", f"""{_PANEL}, d AS (SELECT e, o, count(*) AS rows, count(DISTINCT o_orderstatus) AS kinds FROM p GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT CASE WHEN kinds = 1 THEN 'exact' ELSE 'conflicting' END AS kind, count(*) AS pairs, sum(rows - 1)::BIGINT AS surplus, max(rows) AS max_rows FROM d GROUP BY 1""")
def panel_duplicates(spark, sf_dir):
    return duplicates(orders_panel(spark, sf_dir), ["o_orderstatus"])


_CELLS = f"""{_PANEL}, st AS (SELECT e, min(o_orderstatus) AS segment FROM p GROUP BY e HAVING min(o_orderstatus) = max(o_orderstatus) AND count(*) = count(o_orderstatus)),
 cells AS (SELECT segment, o, count(*) AS required, count(*) FILTER (WHERE got) AS received, avg(got::INT) AS coverage FROM both_ JOIN st USING (e) GROUP BY 1, 2)"""


@query("panel_segment_cells", f"""{_CELLS} SELECT segment, o::INT AS ordinal, required, received, round(coverage, 6) AS coverage, (o // 4) || '-Q' || (o % 4 + 1) AS period, round(median(coverage) OVER (PARTITION BY o), 6) AS peer_median FROM cells""")
def panel_segment_cells(spark, sf_dir):
    cells = peer_coverage(segment_cells(orders_panel(spark, sf_dir), "o_orderstatus", "quarter"))
    return cells.withColumns({"coverage": rounded(F.col("coverage")), "peer_median": rounded(F.col("peer_median"))})


@query("panel_windowed_grid", """WITH p AS (SELECT o_custkey::VARCHAR AS e, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS o FROM orders)
 SELECT e AS entity_key, greatest(min(o), 1996 * 12)::INT AS start, max(o)::INT AS last, (max(o) - min(o) + 1 - count(DISTINCT o))::BIGINT AS interior_gaps, min(o) < 1996 * 12 AS contradiction FROM p GROUP BY e""")
def panel_windowed_grid(spark, sf_dir):
    return windowed_grid(orders_panel(spark, sf_dir, "month").withColumn("origin", F.lit("1996-01-01").cast("date")), "origin")


@query("panel_invalid_rows", """SELECT CASE WHEN event_type = 'error' THEN 'bad period' ELSE 'blank entity' END AS invalid, count(*) AS rows FROM events WHERE event_type = 'error' OR user_id % 10 = 0 AND event_type <> 'error' GROUP BY 1""")
def panel_invalid_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"who": F.when((F.col("user_id") % 10 == 0) & (F.col("event_type") != "error"), " ").otherwise(F.col("user_id").cast("string")), "when_": F.when(F.col("event_type") == "error", F.lit("2024-Q1")).otherwise(F.date_format("ts", "yyyy-MM"))})
    return invalid_rows(prepared(e, "who", "when_", "month"))


@query("panel_identifier_hygiene", "SELECT count(*) FILTER (WHERE p_type IS NULL OR trim(p_type) = '') AS blanks, count(DISTINCT p_name) - count(DISTINCT lower(trim(p_name))) AS collisions FROM part")
def panel_identifier_hygiene(spark, sf_dir):
    return identifier_hygiene(table(spark, sf_dir, "part"), "p_name")


@query("panel_granularity", """WITH m AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), g AS (SELECT m - lag(m) OVER (ORDER BY m) AS gap FROM m), n AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1)
 SELECT arg_min(gap, (-n, gap))::INT AS modal_gap, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) >= 0.8 AS confirmed FROM n""")
def panel_granularity(spark, sf_dir):
    return granularity(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("share", rounded(F.col("share")))


def order_cases(spark, sf_dir):
    """A case: a customer's orders of one year, opened at the first of them; its status is that of the last."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.to_date("o_orderdate"))
    o = o.withColumn("anchor", F.min("at").over(Window.partitionBy("o_custkey", F.year("at"))))
    c = cases(o, "o_custkey", "anchor", "o_orderstatus", "at")
    money = o.groupBy(F.col("o_custkey").alias("entity"), "anchor").agg(F.sum("o_totalprice").alias("loss"))
    return c.join(money, ["entity", "anchor"]).withColumn("cured", F.col("last_status") == "F")


_CASES = """WITH o AS (SELECT *, o_orderdate::DATE AS day_ FROM orders), a AS (SELECT *, min(day_) OVER (PARTITION BY o_custkey, year(day_)) AS anchor FROM o),
 c AS (SELECT o_custkey AS entity, anchor, arg_max(o_orderstatus, (day_, o_orderstatus)) AS last_status, max(day_) AS last_at, year(anchor) AS vintage, (max(day_) - anchor)::INT AS days, sum(o_totalprice) AS loss FROM a GROUP BY o_custkey, anchor),
 m AS (SELECT * FROM c WHERE 2001 * 12 + 6 - (vintage * 12 + 12) >= 12)"""


def mature_cases(spark, sf_dir):
    return mature(order_cases(spark, sf_dir), "2001-06-30", 12)


@query("vintage_resolution", f"""{_CASES} SELECT vintage::INT AS vintage, count(*) AS cases, round(avg((last_status IN ('F', 'P'))::INT), 6) AS rate, CASE WHEN count(*) < 5 THEN 'TOO-FEW' WHEN avg((last_status IN ('F', 'P'))::INT) >= 0.6 THEN 'PASS' ELSE 'VIOLATION' END AS verdict FROM m GROUP BY 1""")
def vintage_resolution(spark, sf_dir):
    return resolution(mature_cases(spark, sf_dir), ["F", "P"], ["vintage"], 0.6).withColumn("rate", rounded(F.col("rate")))


@query("vintage_loss", f"""{_CASES} SELECT vintage::INT AS vintage, round(avg(loss), 2) AS mean, round(median(loss), 2) AS median, round(avg((last_status NOT IN ('F', 'P'))::INT), 6) AS open_share, CASE WHEN avg((last_status NOT IN ('F', 'P'))::INT) > 0.3 THEN 'CENSORED' END AS stamp FROM m GROUP BY 1""")
def vintage_loss(spark, sf_dir):
    return loss_by_vintage(mature_cases(spark, sf_dir), "loss", ["F", "P"], 0.3).withColumns({"mean": rounded(F.col("mean"), 2), "median": rounded(F.col("median"), 2), "open_share": rounded(F.col("open_share"))})


@query("vintage_mix_gap", f"""{_CASES}, g AS (SELECT vintage, count(*) AS cases, sum((last_status = 'F')::INT) AS hits FROM m GROUP BY 1) SELECT vintage::INT AS vintage, cases, hits::BIGINT AS hits, round(hits / cases - sum(hits) OVER () / sum(cases) OVER (), 6) AS gap FROM g""")
def vintage_mix_gap(spark, sf_dir):
    return mix_gap(mature_cases(spark, sf_dir), "cured").withColumn("gap", rounded(F.col("gap")))


@query("vintage_stale_open", f"""{_CASES} SELECT vintage::INT AS vintage, count(*) AS cases FROM c WHERE last_status NOT IN ('F', 'P') AND (DATE '2001-06-30' - anchor) / 30.44 > 36 GROUP BY 1""")
def vintage_stale_open(spark, sf_dir):
    return stale_open(order_cases(spark, sf_dir), ["F", "P"], "2001-06-30", 24).groupBy("vintage").agg(F.count("*").alias("cases"))


@query("vintage_zero_share", f"""{_CASES} SELECT vintage::INT AS vintage, round(avg((days = 0)::INT), 6) AS zero_share FROM m GROUP BY 1""")
def vintage_zero_share(spark, sf_dir):
    """Share of cases without any further activity (VR-7)."""
    return mature_cases(spark, sf_dir).groupBy("vintage").agg(rounded(F.avg((F.col("days") == 0).cast("int"))).alias("zero_share"))


@query("vintage_median_gap", f"""{_CASES} SELECT vintage::INT AS vintage, median(days) AS median, (SELECT median(days) FROM m) AS pooled, median(days) - (SELECT median(days) FROM m) AS gap FROM m GROUP BY 1""")
def vintage_median_gap(spark, sf_dir):
    return median_gap(mature_cases(spark, sf_dir), "days")


@query("vintage_segment_cells", f"""{_CASES}, s AS (SELECT m.*, c_mktsegment AS segment FROM m JOIN customer ON c_custkey = entity) SELECT vintage::INT AS vintage, segment, count(*) AS cases, round(avg((last_status = 'F')::INT), 6) AS rate, CASE WHEN count(*) < 5 THEN 'TOO-FEW' WHEN avg((last_status = 'F')::INT) >= 0.4 THEN 'PASS' ELSE 'VIOLATION' END AS verdict FROM s GROUP BY 1, 2""")
def vintage_segment_cells(spark, sf_dir):
    c = mature_cases(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")), "entity")
    return resolution(c, ["F"], ["vintage", "segment"], 0.4).withColumn("rate", rounded(F.col("rate")))


@query("vintage_later_event", """SELECT o_orderstatus, count(*) AS n FROM orders a WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND b.o_orderdate::DATE > a.o_orderdate::DATE AND b.o_orderdate::DATE <= a.o_orderdate::DATE + INTERVAL 6 MONTH) GROUP BY 1""")
def vintage_later_event(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.to_date("o_orderdate"))
    return later_event(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "at", 6).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("vintage_longest_segment", """WITH p AS (SELECT o_custkey, o_orderstatus AS s, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS d FROM orders GROUP BY 1, 2), g AS (SELECT s, median(d) AS m, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 20) SELECT arg_max(s, (m, s)) AS segment, max(m) AS median_days FROM g""")
def vintage_longest_segment(spark, sf_dir):
    return longest_segment(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderdate")


@query("vintage_guards", "SELECT count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-06-30') AS rows_after_as_of, count(*) AS rows, 'recovery' AS absent, false AS passed FROM orders")
def vintage_guards(spark, sf_dir):
    return guards(table(spark, sf_dir, "orders"), ["o_orderdate", "recovery"], "o_orderdate", "2001-06-30")
