"""Definitions over the benchmark tables, a query for each operator, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Batch, Engine
from .lang import nodes as N
from .lang.checker import compile_source
from .operators import facts as ops
from .operators.changes import diff, ranked
from .plans.figures import Planner
from .plans.projections import Projections, named
from .plans.readings import Readings
from .sources import tables

#: The instant of every query; never the wall clock.
AT = dt.datetime(2001, 9, 1, 12, 0, 0)
#: The instant of queries over events, which lie in January 2024.
AT_EVENTS = dt.datetime(2024, 1, 30, 12, 0, 0)

GRAINS = {"minute": "minute", "quarter_hour": "15 minutes", "hour": "hour", "day": "day", "week": "week", "month": "month", "quarter": "quarter"}

DEFINITIONS = (
    """
# A nation, whose customers and suppliers trade.
fact nation:
    name n_name
    n_nationkey as number
    n_name as text
    n_regionkey as number

# A nation as a site with a calendar.
fact site:
    name n_name
    n_nationkey as number
    n_name as text
    timezone as text

# A market segment.
fact segment:
    name c_mktsegment
    c_mktsegment as text

# Somebody who orders.
fact customer:
    name c_name
    c_custkey as number
    c_name as text
    c_nationkey as number
    c_acctbal as number
    c_mktsegment as text

# Somebody who supplies.
fact supplier:
    name s_name
    s_suppkey as number
    s_name as text
    s_nationkey as number
    s_acctbal as number

# One order.
fact order:
    o_orderkey as number
    o_custkey as number
    o_orderstatus as text
    o_totalprice as number
    o_orderdate as moment
    o_orderpriority as text

# One line of an order, with the order's date.
fact line:
    l_orderkey as number
    l_suppkey as number
    l_quantity as number
    l_extendedprice as number
    l_returnflag as text
    l_shipdate as moment
    o_orderdate as moment

# Somebody who uses the shop.
fact person:
    user_id as number

# Somebody who uses the shop, with a calendar of their own.
fact traveller:
    user_id as number
    timezone as text

# One thing that somebody did.
fact event:
    event_id as number
    ts as moment
    user_id as number
    event_type as text
    value as number

# A source of documents.
fact source:
    name source
    source as text

# One document.
fact document:
    doc_id as number
    lang as text
    source as text
    n_chars as number

# What was found about a document.
fact label:
    doc_id as number
    quality as number
    toxic as number

group order.by_customer from o_custkey
group order.by_customer_month from (o_custkey, o_orderdate by month)
group order.by_customer_quarter from (o_custkey, o_orderdate by quarter)
group order.by_first_monday from (o_custkey, o_orderdate by first monday of month)
group customer.by_nation from c_nationkey through nation.n_nationkey
group customer.by_site from c_nationkey through site.n_nationkey
group customer.by_nation_segment from (c_nationkey through nation.n_nationkey, c_mktsegment)
group line.by_supplier from l_suppkey
group line.by_supplier_month from (l_suppkey, l_shipdate by month)
group line.by_supplier_span from (l_suppkey, o_orderdate until l_shipdate by quarter in "UTC")
group line.by_supplier_left from (l_suppkey, o_orderdate until l_shipdate by quarter in "UTC" excluding quarters gone)
group line.by_supplier_late from (l_suppkey, o_orderdate until l_shipdate by quarter in "UTC" carrying overdue quarters)
group line.by_supplier_rest from (l_suppkey, o_orderdate until l_shipdate by quarter in "UTC" excluding quarters gone carrying overdue quarters)
group event.by_person from user_id
group event.by_traveller_day from (user_id, ts by day in traveller.timezone)
group event.by_person_tokyo from (user_id, ts by day in "Asia/Tokyo")
group document.by_source from source
"""
    + "".join(f"group event.by_person_{n} from (user_id, ts by {g})\n" for n, g in GRAINS.items())
    + """
filter order.open where o_orderstatus == "O"
filter order.not_open where o_orderstatus != "O"
filter order.urgent where o_orderpriority == "1-URGENT"
filter order.priced where o_totalprice is set
filter order.unpriced where o_totalprice is not set
filter order.stale where o_orderdate older than 1500 days
filter order.fresh where o_orderdate younger than 1500 days
filter order.older_than_credit where o_orderdate older than c_acctbal from o_custkey through customer.c_custkey
filter line.returned where l_returnflag == "R"
filter line.shipped where l_shipdate is set
filter event.purchase where event_type == "purchase"
filter event.error where event_type == "error"
filter event.timed where ts is set
filter document.english where lang == "en"
filter label.good keyed as document where quality == 1
filter label.toxic keyed as document where toxic == 1

measure line.lead = l_shipdate - o_orderdate
measure line.quantity = l_quantity in count
measure order.placed = moment o_orderdate
measure order.price = o_totalprice in amount
measure event.age = now - ts

# Open orders of a customer.
figure customer.open_orders:
    display "{customer} has {value} open orders"
    depends:
        mine = order.by_customer:{customer} & order.open
    calculate:
        count(mine)
    band:
        when value >= 8 then "busy"
        when value >= 3 then "normal"
        otherwise "quiet"

# Orders that aren't open.
figure customer.other_orders:
    display "{customer} other orders"
    depends:
        mine = order.by_customer:{customer} & order.not_open
    calculate:
        count(mine)

# Orders that are open or urgent.
figure customer.open_or_urgent:
    display "{customer} open or urgent"
    depends:
        mine = order.by_customer:{customer} & (order.open | order.urgent)
    calculate:
        count(mine)

# Open orders that aren't urgent.
figure customer.open_not_urgent:
    display "{customer} open, not urgent"
    depends:
        all_open = order.by_customer:{customer} & order.open
        mine = all_open - order.urgent
    calculate:
        count(mine)

# Orders with and without a price.
figure customer.priced_orders:
    display "{customer} priced"
    depends:
        mine = order.by_customer:{customer} & order.priced - order.unpriced
    calculate:
        count(mine)

# What a customer has spent.
figure customer.spend:
    display "{customer} spent {value}"
    unit amount
    depends:
        mine = order.by_customer:{customer}
    calculate:
        sum(order.o_totalprice over mine)
    band:
        when value > 1500000 then "large"
        when value > customer.c_acctbal * 100 then "over"
        otherwise "within"

# What a customer's open orders come to.
figure customer.open_value:
    display "{customer} open value"
    depends:
        mine = order.by_customer:{customer} & order.open
    calculate:
        sum(order.price over mine)

# The share of a customer's spending that is open.
figure customer.open_share:
    display "{customer} open share"
    unit share
    calculate:
        customer.open_value / customer.spend

# The larger of spending and balance, the smaller of open and other orders, and both together.
figure customer.mixed:
    display "{customer} mixed"
    unit amount
    calculate:
        max(customer.spend, customer.c_acctbal) + 2 * min(customer.open_orders, customer.other_orders) - 1

# How a customer stands.
figure customer.standing:
    display "{customer} standing"
    calculate:
        when customer.open_share is nothing then "new"
        when customer.open_share > 0.5 then "open"
        when customer.c_acctbal < 0 then "owing"
        otherwise "settled"

# When a customer ordered last.
figure customer.last_order:
    display "{customer} last order"
    depends:
        mine = order.by_customer:{customer}
    calculate:
        latest(order.placed over mine)

# When a customer ordered first.
figure customer.first_open_order:
    display "{customer} first open order"
    depends:
        mine = order.by_customer:{customer} & order.open
    calculate:
        earliest(order.placed over mine)

# Orders that are old, that are not, and older than the customer's balance in days.
figure customer.stale_orders:
    display "{customer} stale"
    depends:
        mine = order.by_customer:{customer} & order.stale
    calculate:
        count(mine)

# Orders that aren't old.
figure customer.fresh_orders:
    display "{customer} fresh"
    depends:
        mine = order.by_customer:{customer} & order.fresh
    calculate:
        count(mine)

# Orders older than the customer's balance in days.
figure customer.older_than_credit:
    display "{customer} older than credit"
    depends:
        mine = order.by_customer:{customer} & order.older_than_credit
    calculate:
        count(mine)

# Customers of a nation.
figure nation.customers:
    display "{nation} customers"
    depends:
        mine = customer.by_nation:{nation}
    calculate:
        count(mine)

# Open orders of a nation's customers.
figure nation.open_orders:
    display "{nation} open orders"
    depends:
        mine = customer.by_nation:{nation}
    calculate:
        sum(customer.open_orders over mine)

# The open shares of a nation's customers, added up.
figure nation.open_shares:
    display "{nation} open shares"
    depends:
        mine = customer.by_nation:{nation}
    calculate:
        sum(customer.open_share over mine)

# Customers of a nation in each segment.
figure nation.customers_by_segment across segment:
    display "{nation} in {segment}"
    depends:
        mine = customer.by_nation_segment:{nation}
    calculate:
        count(mine)

# Customers of a nation in all segments.
figure nation.customers_in_segments:
    display "{nation} in segments"
    calculate:
        sum(nation.customers_by_segment)

# Orders on the first Monday of a month.
figure customer.first_mondays bucketed:
    display "{customer} first Mondays"
    depends:
        mine = order.by_first_monday:{customer}
    calculate:
        count(mine)

# The price of the latest order of each quarter, in force until the next.
figure customer.price_in_force bucketed:
    display "{customer} price in force"
    unit amount
    depends:
        mine = order.by_customer_quarter:{customer} & order.open
    calculate:
        latest(order.o_totalprice over mine) carried forward

# The priority of the earliest order of each quarter.
figure customer.first_priority bucketed:
    display "{customer} first priority"
    depends:
        mine = order.by_customer_quarter:{customer}
    calculate:
        earliest(order.o_orderpriority over mine)

# What a customer spent each quarter.
figure customer.quarter_spend bucketed:
    display "{customer} quarter"
    depends:
        mine = order.by_customer_quarter:{customer}
    calculate:
        sum(order.price over mine)

# Orders of each quarter.
figure customer.quarter_orders bucketed:
    display "{customer} orders of the quarter"
    depends:
        mine = order.by_customer_quarter:{customer}
    calculate:
        count(mine)

# Spending an order, each quarter.
figure customer.quarter_mean bucketed:
    display "{customer} an order"
    unit amount
    calculate:
        customer.quarter_spend:{bucket} / customer.quarter_orders:{bucket}

# A customer's spending dealt out to the quarters of its orders.
figure customer.spend_spread bucketed:
    display "{customer} spread"
    depends:
        mine = order.by_customer_quarter:{customer}
    calculate:
        spread(customer.spend over mine)

# Lead times of each month's shipments.
figure supplier.leads bucketed:
    display "{supplier} leads"
    depends:
        mine = line.by_supplier_month:{supplier} & line.returned
    calculate:
        list(line.lead over mine)

# The median lead time of each month's shipments.
figure supplier.lead_median bucketed:
    display "{supplier} median lead"
    depends:
        mine = line.by_supplier_month:{supplier} & line.returned
    calculate:
        median(line.lead over mine)

# The mean lead time of each month's shipments.
figure supplier.lead_mean bucketed:
    display "{supplier} mean lead"
    depends:
        mine = line.by_supplier_month:{supplier}
    calculate:
        mean(line.lead over mine)

# The longest lead time of each month's shipments.
figure supplier.lead_worst bucketed:
    display "{supplier} worst lead"
    depends:
        mine = line.by_supplier_month:{supplier}
    calculate:
        worst(line.lead over mine)

# Pieces shipped each month.
figure supplier.pieces bucketed:
    display "{supplier} pieces"
    depends:
        mine = line.by_supplier_month:{supplier}
    calculate:
        sum(line.quantity over mine)

# Lines under way each quarter.
figure supplier.under_way bucketed:
    display "{supplier} under way"
    depends:
        mine = line.by_supplier_span:{supplier}
    calculate:
        count(mine)

# Lines under way in quarters to come.
figure supplier.left bucketed:
    display "{supplier} left"
    depends:
        mine = line.by_supplier_left:{supplier}
    calculate:
        count(mine)

# Lines whose quarters are all over, now.
figure supplier.late bucketed:
    display "{supplier} late"
    depends:
        mine = line.by_supplier_late:{supplier}
    calculate:
        count(mine)

# Lines by the quarters left, those over now.
figure supplier.rest bucketed:
    display "{supplier} rest"
    depends:
        mine = line.by_supplier_rest:{supplier}
    calculate:
        count(mine)

# What a traveller did each day of their own calendar.
figure traveller.days bucketed:
    display "{traveller} own day"
    depends:
        mine = event.by_traveller_day:{traveller}
    calculate:
        count(mine)

# What a person did each day in Tokyo.
figure person.tokyo_days bucketed:
    display "{person} Tokyo day"
    depends:
        mine = event.by_person_tokyo:{person}
    calculate:
        count(mine)

# The value of a person's latest event each day.
figure person.last_value bucketed:
    display "{person} last value"
    unit amount
    depends:
        mine = event.by_person_day:{person}
    calculate:
        latest(event.value over mine)

# English documents of a source that were found good.
figure source.good_documents:
    display "{source} good documents"
    depends:
        mine = document.by_source:{source} & document.english & label.good - label.toxic
    calculate:
        count(mine)

# Characters of a source's documents.
figure source.characters:
    display "{source} characters"
    unit count
    depends:
        mine = document.by_source:{source}
    calculate:
        sum(document.n_chars over mine)
"""
    + "".join(
        f"""
# What a person did, {n.replace("_", " ")} by {n.replace("_", " ")}.
figure person.events_{n} bucketed:
    display "{{person}} events"
    depends:
        mine = event.by_person_{n}:{{person}} & event.timed
    calculate:
        count(mine)
"""
        for n in GRAINS
    )
    + """
# A target for each month: the mean lead of all its lines.
reading supplier.lead_times(range):
    display "{supplier} lead times"
    depends:
        leads = supplier.leads in range
    requires:
        at least 2 values in leads
    calculate:
        mean(leads)
        median(leads)
        worst(leads)
        percentile 90 of leads
    band on median:
        when value > supplier.lead_mean then "slow"
        when value < 0 then "early"
        otherwise "fair"

# Pieces month by month.
reading supplier.piece_series(range):
    display "{supplier} pieces"
    depends:
        months = supplier.pieces in range
    calculate:
        sum(months)
        per_bucket(months)
        series(months)
        delta(months)

# Events day by day.
reading person.days(range):
    display "{person} days"
    depends:
        days = person.events_day in range
    calculate:
        sum(days)
        per_bucket(days)

# How long ago a person bought or failed.
reading person.since():
    display "{person} since"
    depends:
        waiting = event.age over (event.by_person:{person} & event.purchase)
    calculate:
        count(waiting)
        mean(waiting)
        worst(waiting)

# One row for each order.
projection order.page:
    from order.open | order.urgent
    sort by price descending
    limit 50
    field:
        price = o_totalprice as number
        status = o_orderstatus as text
        placed = o_orderdate as date
        segment = c_mktsegment from o_custkey through customer.c_custkey as text
    value:
        age in days = days from placed to now
        old in count =
            when age >= 2000 then 1
            otherwise 0
        net in amount = price - 1000
    flag order-old when old == 1:
        label "Old by {age}"
        detail "Placed on {placed}."
        action "Look at it."
        severity attention
    omit when net < 0

# One row for each customer.
projection customer.card:
    field:
        name = c_name as text
        balance = c_acctbal as number
    read:
        open = customer.open_orders
        level = band of customer.open_orders
        share = customer.open_share
    value:
        weight in count =
            when level == "busy" then 2
            when share > 0.5 then 1
            otherwise 0

# Orders of one customer and month.
projection order.of_month scoped by order.by_customer_month:
    field:
        price = o_totalprice as number
    sort by price ascending

# All orders of the page in one row.
summarise order.totals over order.page:
    count orders
    count old_orders where old == 1
    total worth in amount = price
    total old_worth in amount = price where old == 1
    value:
        verdict =
            when old_orders > 10 then "old"
            otherwise "fresh"

# All customers in one row.
summarise customer.totals over customer.card:
    count customers
    count busy where level == "busy"
    total open = open
    total shares in share = share

# What a customer's page shows.
bundle customer.page:
    open = figure customer.open_orders
    cards = projection customer.card
    totals = summarise customer.totals
"""
)
DEFINITIONS = DEFINITIONS.replace("    total open = open\n", "    total open_orders = open\n")


@lru_cache(maxsize=1)
def library() -> N.Library:
    return compile_source(DEFINITIONS)


def planner(spark: SparkSession, sf_dir: str, at: dt.datetime = AT) -> Planner:
    return Planner(library(), tables.kinds(spark, sf_dir), at)


Query = Callable[[SparkSession, str], DataFrame]


def _typed(df: DataFrame, subject: str, kind: str = "long") -> DataFrame:
    return df.withColumn(subject, F.col("subject").cast(kind)).drop("subject")


def _figure(name: str, subject: str, value: str = "value", kind: str = "long", digits: int | None = None, at: dt.datetime = AT) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = planner(spark, sf_dir, at).figure(name).withColumnRenamed("value", value)
        return _typed(df.withColumn(value, F.round(value, digits)) if digits is not None else df, subject, kind)

    return run


def _banded(name: str, subject: str, digits: int = 2) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _typed(planner(spark, sf_dir).banded(name).withColumn("value", F.round("value", digits)), subject)

    return run


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = planner(spark, sf_dir).figure("supplier.leads")
    return df.select(F.col("subject").cast("long").alias("s_suppkey"), "tail", F.explode("value").alias("lead"))


def _reading(name: str, subject: str, windows: list[str], at: dt.datetime, columns: list[str], pool: list[str] | None = None, digits: int = 4) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Readings(planner(spark, sf_dir, at)).reading(name, windows, at, pool, bool(pool))
        rounded = [F.round(c, digits).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in columns]
        out = df.select("subject", "window", *rounded)
        return out if pool else _typed(out, subject)

    return run


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Readings(planner(spark, sf_dir, AT_EVENTS)).reading("person.since")
    return _typed(df.select("subject", "window", "count", F.round("mean", 1).alias("mean"), F.round("worst", 6).alias("worst")), "user_id")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = dt.datetime(2000, 12, 31)
    df = Readings(planner(spark, sf_dir, at)).reading("supplier.piece_series", ["6", "1-12"], at)
    zipped = F.arrays_zip(F.col("series"), F.col("delta"), F.col("series_scale"))
    return df.select(F.col("subject").cast("long").alias("s_suppkey"), "window", F.posexplode(zipped).alias("ord", "z")).select("s_suppkey", "window", "ord", "z.series", "z.delta", F.round("z.series_scale", 8).alias("series_scale"))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Projections(planner(spark, sf_dir)).projection("order.page")
    return df.select(F.col("id").cast("long").alias("o_orderkey"), "price", "status", "segment", F.round("age", 6).alias("age"), "old", F.round("net", 2).alias("net"), F.size("flags").alias("fired"))


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = named(Projections(planner(spark, sf_dir)).projection("customer.card"))
    return df.select(F.col("id").cast("long").alias("c_custkey"), "row_name", "name", "balance", "open", "level", F.round("share", 8).alias("share"), "weight")


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of the month of the first order of the first customer that has any."""
    p = planner(spark, sf_dir)
    first = p.records["order"].agg(F.min(F.struct("o_custkey", "o_orderdate")).alias("f")).select(F.col("f.o_custkey").cast("string"), F.date_format("f.o_orderdate", "yyyy-MM")).first()
    df = Projections(p).projection("order.of_month", (first[0], first[1]))
    return df.select(F.col("id").cast("long").alias("o_orderkey"), "price")


def _summary(name: str, digits: int = 2) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Projections(planner(spark, sf_dir)).summary(name).drop("flags")
        return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    return run


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders before and after the orders of 2001 were written."""
    records = tables.kinds(spark, sf_dir)
    new = Planner(library(), records, AT)
    before = tables.kinds(spark, sf_dir)
    before["order"] = records["order"].where("o_orderdate < timestamp'2001-01-01'")
    old = Planner(library(), before, AT)
    return _typed(diff(old.figure("customer.open_orders"), new.figure("customer.open_orders"), ["subject"]), "c_custkey")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _changes(spark, sf_dir).withColumnRenamed("c_custkey", "subject")
    return _typed(ranked(d).select("subject", "weight"), "c_custkey")


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = planner(spark, sf_dir).citations("customer.open_orders")
    return df.select(F.col("subject").cast("long").alias("c_custkey"), F.col("member").cast("long").alias("o_orderkey"))


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planner(spark, sf_dir)
    every = [p.citations(n).select(F.lit(n).alias("figure"), "subject", F.lit(None).cast("string").alias("tail"), "member") for n in ("customer.open_orders", "customer.spend", "customer.other_orders")]
    member = p.records["order"].agg(F.min(F.col("key").cast("long")).cast("string")).first()[0]
    found = every[0].unionByName(every[1]).unionByName(every[2])
    return ops.citing(found, member, 10).select("figure", F.col("subject").cast("long").alias("c_custkey"))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after one batch: a changed price for every seventh, a stale one for every eleventh, none for the rest."""
    stamp = lambda d: F.lit(d).cast("timestamp")
    old = tables.kinds(spark, sf_dir)["order"].select("key", stamp("2001-01-02").alias("source_stamp"), "o_orderkey", "o_totalprice")
    fresh = old.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("source_stamp", stamp("2001-01-03"))
    stale = old.where("o_orderkey % 11 = 0 and o_orderkey % 7 <> 0").withColumn("o_totalprice", F.lit(0.0)).withColumn("source_stamp", stamp("2001-01-01"))
    table, moved = ops.upsert(old, fresh.unionByName(stale))
    return ops.delete(table, moved.where("cast(key as long) % 14 = 0")).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def _engine(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple[Engine, DataFrame, DataFrame]:
    """An engine of some figures and what they read over customers and orders, and both as frames of records."""
    records = tables.kinds(spark, sf_dir)
    source = library()
    stamped = lambda kind: records[kind].select("key", F.lit(None).cast("timestamp").alias("source_stamp"), *[p for p, _ in source.facts[kind].fields if p != "o_orderdate"], *(["o_orderdate"] if kind == "order" else []))
    small = N.Library(
        facts={k: source.facts[k] for k in ("customer", "order")}, groups={"order.by_customer": source.groups["order.by_customer"]},
        filters={n: source.filters[n] for n in ("order.open", "order.not_open")}, measures=source.measures, figures={n: source.figures[n] for n in names},
        projections={"customer.card": source.projections["customer.card"]}, summaries={"customer.totals": source.summaries["customer.totals"]}, bundles={"customer.page": source.bundles["customer.page"]},
    )
    return Engine(spark, small), stamped("customer"), stamped("order")


def _warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders after a warm pass over the orders of 2001, on top of a full one over those before."""
    engine, people, orders = _engine(spark, sf_dir, ["customer.open_orders", "customer.other_orders"])
    engine.apply(Batch(writes={"customer": people, "order": orders.where("o_orderdate < timestamp'2001-01-01'")}), AT)
    engine.apply(Batch(writes={"order": orders.where("o_orderdate >= timestamp'2001-01-01'")}), AT)
    return _typed(engine.store.get("values", "customer.open_orders").withColumnRenamed("value", "open_orders"), "c_custkey")


def _deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders where most orders were landed without a pass, and another engine on the same state then got the rest."""
    engine, people, orders = _engine(spark, sf_dir, ["customer.open_orders"])
    engine.apply(Batch(writes={"customer": people, "order": orders.where("o_orderkey % 10 = 0")}), AT)
    engine.apply(Batch(writes={"order": orders.where("o_orderkey % 10 > 1")}, defer=True), AT)
    later = Engine(spark, engine.library, engine.store)
    later.apply(Batch(writes={"order": orders.where("o_orderkey % 10 = 1")}), AT)
    return _typed(later.store.get("values", "customer.open_orders").withColumnRenamed("value", "open_orders"), "c_custkey")


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the slots of a customer's page say, summed up: a row for each slot."""
    engine, people, orders = _engine(spark, sf_dir, ["customer.open_orders", "customer.spend", "customer.open_value", "customer.open_share"])
    engine.apply(Batch(writes={"customer": people, "order": orders}), AT)
    page = engine.answer("customer.page", at=AT)
    told = lambda slot, n: page[slot].rows.agg(F.lit(slot).alias("slot"), F.lit(page[slot].state).alias("state"), n.cast("double").alias("n"))
    return told("open", F.sum("value")).unionByName(told("cards", F.count("row_name"))).unionByName(told("totals", F.sum("open_orders")))


def _labels(grain: str) -> str:
    return {
        "minute": "strftime(ts, '%Y-%m-%dT%H:%M')",
        "quarter_hour": "strftime(ts, '%Y-%m-%dT%H:') || lpad((minute(ts) // 15 * 15)::varchar, 2, '0')",
        "hour": "strftime(ts, '%Y-%m-%dT%H:00')",
        "day": "strftime(ts, '%Y-%m-%d')",
        "week": "strftime(ts, '%G-W%V')",
        "month": "strftime(ts, '%Y-%m')",
        "quarter": "year(ts) || '-Q' || quarter(ts)",
    }[grain]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "open_orders": _figure("customer.open_orders", "c_custkey", "open_orders"),
        "not_open_orders": _figure("customer.other_orders", "c_custkey", "other_orders"),
        "set_union": _figure("customer.open_or_urgent", "c_custkey"),
        "set_difference": _figure("customer.open_not_urgent", "c_custkey"),
        "set_presence": _figure("customer.priced_orders", "c_custkey"),
        "customer_spend": _figure("customer.spend", "c_custkey", "spend", digits=2),
        "spend_band": _banded("customer.spend", "c_custkey"),
        "count_band": _banded("customer.open_orders", "c_custkey"),
        "open_value_measure": _figure("customer.open_value", "c_custkey", digits=2),
        "open_share": _figure("customer.open_share", "c_custkey", "share", digits=8),
        "picks_and_arithmetic": _figure("customer.mixed", "c_custkey", digits=2),
        "standing_ladder": _figure("customer.standing", "c_custkey", "standing"),
        "latest_moment": _figure("customer.last_order", "c_custkey", "ms"),
        "earliest_moment": _figure("customer.first_open_order", "c_custkey", "ms"),
        "stale_orders": _figure("customer.stale_orders", "c_custkey"),
        "fresh_orders": _figure("customer.fresh_orders", "c_custkey"),
        "older_than_owner_field": _figure("customer.older_than_credit", "c_custkey"),
        "nation_through": _figure("nation.customers", "n_nationkey", "customers", "int"),
        "figure_total": _figure("nation.open_orders", "n_nationkey", kind="int"),
        "figure_total_unknown": _figure("nation.open_shares", "n_nationkey", kind="int", digits=6),
        "across_segments": _figure("nation.customers_by_segment", "n_nationkey", kind="int"),
        "across_rollup": _figure("nation.customers_in_segments", "n_nationkey", kind="int"),
        "first_monday_orders": _figure("customer.first_mondays", "c_custkey"),
        "carried_value": _figure("customer.price_in_force", "c_custkey"),
        "earliest_text": _figure("customer.first_priority", "c_custkey"),
        "coordinate_join": _figure("customer.quarter_mean", "c_custkey", digits=6),
        "spread_by_quarter": _figure("customer.spend_spread", "c_custkey", digits=6),
        "lead_list": _leads,
        "lead_median": _figure("supplier.lead_median", "s_suppkey", digits=3),
        "lead_mean": _figure("supplier.lead_mean", "s_suppkey", digits=3),
        "lead_worst": _figure("supplier.lead_worst", "s_suppkey", digits=3),
        "measure_sum": _figure("supplier.pieces", "s_suppkey", digits=2),
        "ship_spans": _figure("supplier.under_way", "s_suppkey"),
        "ship_spans_left": _figure("supplier.left", "s_suppkey", at=dt.datetime(1998, 5, 5)),
        "ship_spans_overdue": _figure("supplier.late", "s_suppkey", at=dt.datetime(1998, 5, 5)),
        "ship_spans_rest": _figure("supplier.rest", "s_suppkey", at=dt.datetime(1998, 5, 5)),
        "tokyo_days": _figure("person.tokyo_days", "user_id"),
        "latest_event_value": _figure("person.last_value", "user_id"),
        "good_documents": _figure("source.good_documents", "source", kind="string"),
        "source_characters": _figure("source.characters", "source", kind="string"),
        "reading_distribution": _reading("supplier.lead_times", "s_suppkey", ["12", "13-24", "each:1-3"], dt.datetime(2000, 12, 31), ["sample", "buckets_covered", "buckets_requested", "mean", "median", "worst", "percentile"]),
        "reading_band_goal": _reading("supplier.lead_times", "s_suppkey", ["12"], dt.datetime(2000, 12, 31), ["sample", "level"]),
        "reading_series_delta": _series,
        "reading_sums": _reading("person.days", "user_id", ["30", "14", "7"], AT_EVENTS, ["sample", "buckets_covered", "total", "per_bucket"]),
        "reading_pooled": _reading("supplier.lead_times", "s_suppkey", ["12"], dt.datetime(2000, 12, 31), ["sample", "median", "worst"], ["1", "2", "3"]),
        "reading_live": _live,
        "order_page": _page,
        "order_page_summary": _summary("order.totals"),
        "customer_card": _card,
        "customer_card_summary": _summary("customer.totals", 6),
        "scoped_projection": _month,
        "change_stream": _changes,
        "ranked_changes": _ranked,
        "citations": _citations,
        "citing_figures": _citing,
        "upsert_and_delete": _upsert,
        "warm_pass": _warm,
        "deferred_import": _deferred,
        "bundle": _bundle,
        "own_days": _figure("traveller.days", "user_id"),
    }
    for n in GRAINS:
        out[f"events_by_{n}"] = _figure(f"person.events_{n}", "user_id")
    return out


_OPEN = "SELECT c_custkey, count(o_orderkey)::double AS {name} FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {where} GROUP BY 1"
_Q = "(year(o_orderdate) || '-Q' || quarter(o_orderdate))"
_LINES = "(SELECT l.*, o_orderdate, md5(concat_ws('|', l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate)) AS k FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"
_LEAD = "(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6"
_SPANS = """
WITH s AS (SELECT l_suppkey, date_trunc('quarter', o_orderdate)::date AS a, date_trunc('quarter', l_shipdate)::date AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate),
x AS (SELECT l_suppkey, a, b, unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS d FROM s),
{more}
SELECT l_suppkey AS s_suppkey, year(d) || '-Q' || quarter(d) AS tail, count(*)::double AS value FROM {source} GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    day0 = "(epoch_us(TIMESTAMP '2001-09-01 12:00:00') - epoch_us(o_orderdate)) / 1000.0 / 86400000.0"
    spend = "(SELECT c_custkey, c_acctbal, coalesce(sum(o_totalprice), 0) AS spend, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS open_value, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open_n, count(o_orderkey) FILTER (o_orderstatus <> 'O') AS other_n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"
    by_quarter = f"SELECT o_custkey AS c_custkey, {_Q} AS tail, {{value}} AS value FROM orders GROUP BY ALL"
    by_month = "SELECT l_suppkey AS s_suppkey, strftime(l_shipdate, '%Y-%m') AS tail, {value} AS value FROM " + _LINES + " {where} GROUP BY ALL"
    out = {
        "open_orders": _OPEN.format(name="open_orders", where="o_orderstatus = 'O'"),
        "not_open_orders": _OPEN.format(name="other_orders", where="o_orderstatus IS DISTINCT FROM 'O'"),
        "set_union": _OPEN.format(name="value", where="(o_orderstatus = 'O' OR o_orderpriority = '1-URGENT')"),
        "set_difference": _OPEN.format(name="value", where="o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'"),
        "set_presence": _OPEN.format(name="value", where="coalesce(o_totalprice, 0) <> 0"),
        "customer_spend": f"SELECT c_custkey, round(spend, 2) AS spend FROM {spend}",
        "spend_band": f"SELECT c_custkey, round(spend, 2) AS value, CASE WHEN spend > 1500000 THEN 'large' WHEN c_acctbal IS NULL THEN 'unknown' WHEN spend > c_acctbal * 100 THEN 'over' ELSE 'within' END AS level FROM {spend}",
        "count_band": f"SELECT c_custkey, open_n::double AS value, CASE WHEN open_n >= 8 THEN 'busy' WHEN open_n >= 3 THEN 'normal' ELSE 'quiet' END AS level FROM {spend}",
        "open_value_measure": f"SELECT c_custkey, round(open_value, 2) AS value FROM {spend}",
        "open_share": f"SELECT c_custkey, round(open_value / nullif(spend, 0), 8) AS share FROM {spend}",
        "picks_and_arithmetic": f"SELECT c_custkey, round(CASE WHEN c_acctbal IS NOT NULL THEN greatest(spend, c_acctbal) END + 2 * least(open_n, other_n) - 1, 2) AS value FROM {spend}",
        "standing_ladder": f"SELECT c_custkey, CASE WHEN nullif(spend, 0) IS NULL THEN 'new' WHEN open_value / spend > 0.5 THEN 'open' WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal < 0 THEN 'owing' ELSE 'settled' END AS standing FROM {spend}",
        "latest_moment": "SELECT c_custkey, max(epoch_us(o_orderdate)) / 1000.0 AS ms FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "earliest_moment": "SELECT c_custkey, min(epoch_us(o_orderdate)) / 1000.0 AS ms FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1",
        "stale_orders": _OPEN.format(name="value", where=f"{day0} >= 1500"),
        "fresh_orders": _OPEN.format(name="value", where=f"{day0} < 1500"),
        "older_than_owner_field": _OPEN.format(name="value", where=f"{day0} >= c_acctbal"),
        "nation_through": "SELECT n_nationkey, count(c_custkey)::double AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
        "figure_total": "SELECT n_nationkey, count(o_orderkey)::double AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1",
        "figure_total_unknown": f"SELECT n_nationkey, round(CASE WHEN count(c.c_custkey) = 0 THEN 0 WHEN count(c.c_custkey) = count(open_value / nullif(spend, 0)) THEN sum(open_value / nullif(spend, 0)) END, 6) AS value FROM nation LEFT JOIN customer c ON c_nationkey = n_nationkey LEFT JOIN {spend} s ON s.c_custkey = c.c_custkey GROUP BY 1",
        "across_segments": "SELECT c_nationkey AS n_nationkey, c_mktsegment AS tail, count(*)::double AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL",
        "across_rollup": "SELECT n_nationkey, count(c_custkey)::double AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
        "first_monday_orders": "SELECT o_custkey AS c_custkey, strftime(o_orderdate, '%Y-%m-%d') AS tail, count(*)::double AS value FROM orders WHERE isodow(o_orderdate) = 1 AND day(o_orderdate) <= 7 GROUP BY ALL",
        "carried_value": """
WITH a AS (SELECT o_custkey, date_trunc('quarter', o_orderdate)::date AS d, max_by(o_totalprice, (o_orderdate, o_orderkey::varchar)) FILTER (o_orderstatus = 'O') AS value FROM orders GROUP BY 1, 2),
n AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY o_custkey ORDER BY d) - 1, DATE '2001-07-01') AS upto FROM a)
SELECT o_custkey AS c_custkey, year(q) || '-Q' || quarter(q) AS tail, value FROM (SELECT o_custkey, value, unnest(generate_series(d, upto, INTERVAL 3 MONTH)) AS q FROM n)""",
        "earliest_text": by_quarter.format(value="min_by(o_orderpriority, (o_orderdate, o_orderkey::varchar))"),
        "coordinate_join": by_quarter.format(value="round(sum(o_totalprice) / count(*), 6)"),
        "spread_by_quarter": f"WITH q AS (SELECT DISTINCT o_custkey, {_Q} AS tail FROM orders), s AS (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1) SELECT q.o_custkey AS c_custkey, tail, round(spend / count(*) OVER (PARTITION BY q.o_custkey), 6) AS value FROM q JOIN s ON s.o_custkey = q.o_custkey",
        "lead_list": f"SELECT l_suppkey AS s_suppkey, strftime(l_shipdate, '%Y-%m') AS tail, {_LEAD} AS lead FROM {_LINES} WHERE l_returnflag = 'R'",
        "lead_median": by_month.format(value=f"round(median({_LEAD}), 3)", where="WHERE l_returnflag = 'R'").replace("GROUP BY ALL", "GROUP BY ALL UNION ALL SELECT * FROM (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m') AS t, NULL::double FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND strftime(y.l_shipdate, '%Y-%m') = x.t AND y.l_returnflag = 'R')"),
        "lead_mean": by_month.format(value=f"round(avg({_LEAD}), 3)", where=""),
        "lead_worst": by_month.format(value=f"round(max({_LEAD}), 3)", where=""),
        "measure_sum": by_month.format(value="round(sum(l_quantity), 2)", where=""),
        "ship_spans": _SPANS.format(more="y AS (SELECT 1)", source="x"),
        "ship_spans_left": _SPANS.format(more="y AS (SELECT 1)", source="x WHERE d >= DATE '1998-04-01'"),
        "ship_spans_overdue": _SPANS.format(more="y AS (SELECT l_suppkey, DATE '1998-04-01' AS d FROM s WHERE b < DATE '1998-04-01')", source="y"),
        "ship_spans_rest": _SPANS.format(more="y AS (SELECT l_suppkey, d FROM x WHERE d >= DATE '1998-04-01' UNION ALL SELECT l_suppkey, DATE '1998-04-01' FROM s WHERE b < DATE '1998-04-01')", source="y"),
        "own_days": "WITH z AS (SELECT user_id, ts, CASE user_id % 4 WHEN 0 THEN INTERVAL 9 HOUR WHEN 1 THEN INTERVAL (-5) HOUR WHEN 2 THEN INTERVAL 0 HOUR END AS apart FROM events) SELECT user_id, strftime(ts + apart, '%Y-%m-%d') AS tail, count(*)::double AS value FROM z WHERE apart IS NOT NULL GROUP BY ALL",
        "tokyo_days": "SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS tail, count(*)::double AS value FROM events GROUP BY ALL",
        "latest_event_value": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS tail, max_by(value, (ts, event_id::varchar)) AS value FROM events GROUP BY ALL",
        "good_documents": "SELECT s.source, count(d.doc_id)::double AS value FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT * FROM documents d WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) d ON d.source = s.source GROUP BY 1",
        "source_characters": "SELECT source, sum(n_chars)::double AS value FROM documents GROUP BY 1",
        "reading_sums": """
WITH w(win, n) AS (VALUES ('30', 30), ('14', 14), ('7', 7)),
v AS (SELECT user_id, ts::date AS d, count(*)::double AS c FROM events GROUP BY ALL),
m AS (SELECT user_id, win, n, c FROM v JOIN w ON d > DATE '2024-01-30' - n AND d <= DATE '2024-01-30'),
u AS (SELECT DISTINCT user_id FROM m)
SELECT u.user_id, w.win AS "window", count(c)::int AS sample, count(c)::int AS buckets_covered, CASE WHEN count(c) >= 1 THEN sum(c) END AS total, CASE WHEN count(c) >= 1 THEN round(sum(c) / any_value(w.n), 4) END AS per_bucket
FROM u CROSS JOIN w LEFT JOIN m ON m.user_id = u.user_id AND m.win = w.win GROUP BY ALL""",
        "reading_live": "SELECT u.user_id, 'now' AS \"window\", count(e.ts)::double AS count, round(avg((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(e.ts)) / 1e6), 1) AS mean, round(max((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(e.ts)) / 1e6), 6) AS worst FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND event_type = 'purchase' GROUP BY 1",
        "order_page": f"SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status, c_mktsegment AS segment, round({day0}, 6) AS age, CASE WHEN {day0} >= 2000 THEN 1.0 ELSE 0.0 END::double AS old, round(o_totalprice - 1000, 2) AS net, CASE WHEN {day0} >= 2000 THEN 1 ELSE 0 END::int AS fired FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey::varchar LIMIT 50",
        "order_page_summary": f"WITH p AS (SELECT o_totalprice AS price, {day0} >= 2000 AS old FROM orders WHERE (o_orderstatus = 'O' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 1000) SELECT count(*)::double AS orders, count(*) FILTER (old)::double AS old_orders, round(sum(price), 2) AS worth, round(coalesce(sum(price) FILTER (old), 0), 2) AS old_worth, CASE WHEN count(*) FILTER (old) > 10 THEN 'old' ELSE 'fresh' END AS verdict FROM p",
        "customer_card": f"SELECT c.c_custkey, c_name AS row_name, c_name AS name, c.c_acctbal AS balance, open_n::double AS open, CASE WHEN open_n >= 8 THEN 'busy' WHEN open_n >= 3 THEN 'normal' ELSE 'quiet' END AS level, round(open_value / nullif(spend, 0), 8) AS share, CASE WHEN open_n >= 8 THEN 2.0 WHEN nullif(spend, 0) IS NULL THEN NULL WHEN open_value / spend > 0.5 THEN 1.0 ELSE 0.0 END::double AS weight FROM customer c JOIN {spend} s ON s.c_custkey = c.c_custkey",
        "customer_card_summary": f"SELECT count(*)::double AS customers, count(*) FILTER (open_n >= 8)::double AS busy, sum(open_n)::double AS open_orders, round(CASE WHEN count(*) = count(open_value / nullif(spend, 0)) THEN sum(open_value / nullif(spend, 0)) END, 6) AS shares FROM {spend}",
        "scoped_projection": "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE (o_custkey, strftime(o_orderdate, '%Y-%m')) = (SELECT (o_custkey, strftime(o_orderdate, '%Y-%m')) FROM orders ORDER BY o_custkey, o_orderdate LIMIT 1)",
        "change_stream": "WITH b AS (SELECT c_custkey, count(o_orderkey) FILTER (o_orderdate < TIMESTAMP '2001-01-01')::double AS before, count(o_orderkey)::double AS after FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, 'moved' AS kind, before, after FROM b WHERE before <> after",
        "ranked_changes": "WITH b AS (SELECT c_custkey, count(o_orderkey) FILTER (o_orderdate < TIMESTAMP '2001-01-01')::double AS before, count(o_orderkey)::double AS after FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, after - before AS weight FROM b WHERE before <> after ORDER BY weight DESC, c_custkey LIMIT 40",
        "citations": "SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O'",
        "citing_figures": "WITH o AS (SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) SELECT CASE WHEN o_orderstatus = 'O' THEN 'customer.open_orders' ELSE 'customer.other_orders' END AS figure, o_custkey AS c_custkey FROM o UNION ALL SELECT 'customer.spend', o_custkey FROM o",
        "upsert_and_delete": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice FROM orders WHERE o_orderkey % 14 <> 0",
        "warm_pass": _OPEN.format(name="open_orders", where="o_orderstatus = 'O'"),
        "deferred_import": _OPEN.format(name="open_orders", where="o_orderstatus = 'O'"),
        "bundle": "WITH o AS (SELECT count(*)::double AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O') SELECT 'open' AS slot, 'ok' AS state, n FROM o UNION ALL SELECT 'totals', 'ok', n FROM o UNION ALL SELECT 'cards', 'ok', count(*)::double FROM customer",
    }
    windows = {"12": (1, 12), "13-24": (13, 24), "1-1": (1, 1), "2-2": (2, 2), "3-3": (3, 3)}
    values = ", ".join(f"('{w}', {a}, {b})" for w, (a, b) in windows.items())
    months = f"""
WITH w(win, a, b) AS (VALUES {{values}}),
lab AS (SELECT win, b - a + 1 AS n, b - i AS idx, strftime(DATE '2000-12-01' - to_months((i - 1)::int), '%Y-%m') AS tail FROM w, range(1, 25) r(i) WHERE i BETWEEN a AND b),
v AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS tail, {_LEAD} AS lead, l_returnflag, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
"""
    percentile = "CASE WHEN count(lead) >= 2 THEN list_sort(list(lead) FILTER (lead IS NOT NULL))[greatest(1, (90 * count(lead) + 99) // 100)] END"
    two = lambda x: f"CASE WHEN count(lead) >= 2 THEN round({x}, 4) END"
    out["reading_distribution"] = months.format(values=values) + f"""
m AS (SELECT l_suppkey, win, lab.tail, lead FROM v JOIN lab ON lab.tail = v.tail WHERE l_returnflag = 'R'),
u AS (SELECT DISTINCT l_suppkey FROM m), ws AS (SELECT DISTINCT win, n FROM lab)
SELECT u.l_suppkey AS s_suppkey, ws.win AS "window", count(lead)::int AS sample, count(DISTINCT m.tail)::int AS buckets_covered, any_value(ws.n)::int AS buckets_requested,
 {two("avg(lead)")} AS mean, {two("median(lead)")} AS median, {two("max(lead)")} AS worst, round({percentile}, 4) AS percentile
FROM u CROSS JOIN ws LEFT JOIN m ON m.l_suppkey = u.l_suppkey AND m.win = ws.win GROUP BY u.l_suppkey, ws.win"""
    out["reading_band_goal"] = months.format(values="('12', 1, 12)") + """
m AS (SELECT l_suppkey, win, lab.tail, lead FROM v JOIN lab ON lab.tail = v.tail WHERE l_returnflag = 'R'),
g AS (SELECT l_suppkey, tail, avg(lead) AS goal FROM v GROUP BY 1, 2),
gg AS (SELECT l_suppkey, median(goal) AS goal FROM g JOIN lab ON lab.tail = g.tail GROUP BY 1)
SELECT m.l_suppkey AS s_suppkey, '12' AS "window", count(lead)::int AS sample,
 CASE WHEN count(lead) < 2 THEN 'unknown' WHEN median(lead) > any_value(goal) THEN 'slow' WHEN median(lead) < 0 THEN 'early' ELSE 'fair' END AS level
FROM m JOIN gg ON gg.l_suppkey = m.l_suppkey GROUP BY 1"""
    out["reading_pooled"] = months.format(values="('12', 1, 12)") + """
m AS (SELECT lead FROM v JOIN lab ON lab.tail = v.tail WHERE l_returnflag = 'R' AND l_suppkey IN (1, 2, 3))
SELECT 'pool:1,2,3' AS subject, '12' AS "window", count(lead)::int AS sample, round(median(lead), 4) AS median, round(max(lead), 4) AS worst FROM m HAVING count(lead) >= 2"""
    out["reading_series_delta"] = months.format(values="('6', 1, 6), ('1-12', 1, 12)") + """
p AS (SELECT l_suppkey, tail, sum(l_quantity) AS q FROM v GROUP BY 1, 2),
u AS (SELECT DISTINCT l_suppkey FROM p WHERE tail IN (SELECT tail FROM lab)),
s AS (SELECT u.l_suppkey, win, idx, q FROM u CROSS JOIN lab LEFT JOIN p ON p.l_suppkey = u.l_suppkey AND p.tail = lab.tail)
SELECT l_suppkey AS s_suppkey, win AS "window", idx::int AS ord, q AS series, q - lag(q) OVER (PARTITION BY l_suppkey, win ORDER BY idx) AS delta,
 round(CASE WHEN q IS NULL THEN NULL WHEN max(q) OVER (PARTITION BY l_suppkey, win) > 0 THEN q / max(q) OVER (PARTITION BY l_suppkey, win) ELSE 0 END, 8) AS series_scale FROM s"""
    for n in GRAINS:
        out[f"events_by_{n}"] = f"SELECT user_id, {_labels(n)} AS tail, count(*)::double AS value FROM events GROUP BY ALL"
    return out
