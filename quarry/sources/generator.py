"""IO11: synthetic analytics data in four linked tables (users, products,
sessions, events), scaled from the driver tables and drawn by hashing keys:
no driver-side loops, no collected parents.

Children are exploded from parent rows and inherit their attributes by
construction.  Sessions fall on users by Zipf's law, so a few users have a
large share of them; such a user's sessions are exploded in chunks that are
dealt over tasks first.  Weighted choices use an alias table (one draw, one
look-up, whatever the number of values).  Purchases carry a property map with
a product that exists.  The same seed gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranking import ranked

# Event-type mix in percent (page_view, click, purchase, signup, logout).
EVENT_MIX = [("page_view", 60), ("click", 25), ("purchase", 10), ("signup", 3), ("logout", 2)]
DEVICES = [("desktop", 55), ("mobile", 38), ("tablet", 7)]
CATEGORIES = [("tools", 30), ("garden", 25), ("kitchen", 20), ("books", 15), ("toys", 10)]
#: property names of each kind of event and their values
PROPERTIES = {
    "page_view": {"section": ["top", "middle", "end"], "load_ms": ["100", "200", "400", "800"]},
    "click": {"target": ["search", "cart", "menu", "video"], "section": ["top", "middle", "end"]},
    "purchase": {"payment": ["card", "transfer", "invoice"], "currency": ["EUR", "USD", "GBP"]},
    "signup": {"method": ["mail", "phone"]},
    "logout": {"reason": ["manual", "timeout"]},
}
CHUNK = 1000


def uniform(*parts: Column) -> Column:
    """Uniform draw in [0, 1) from md5 of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10)
    return h.cast("double") / float(16 ** 12)


def alias_table(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """Share with which each cell keeps its own value, and the value it gives otherwise."""
    n, total = len(weights), sum(weights)
    share = [w * n / total for w in weights]
    keep, other = [1.0] * n, list(range(n))
    small = [i for i in range(n) if share[i] < 1]
    large = [i for i in range(n) if share[i] >= 1]
    while small and large:
        s, g = small.pop(), large[-1]
        keep[s], other[s] = share[s], g
        share[g] -= 1 - share[s]
        if share[g] < 1:
            small.append(large.pop())
    return keep, other


def weighted(u: Column, choices: Sequence[tuple[str, float]]) -> Column:
    """A value drawn with its weight by one uniform number."""
    keep, other = alias_table([w for _, w in choices])
    at = F.least(F.floor(u * len(choices)), F.lit(len(choices) - 1)).cast("int")
    names = F.array(*[F.lit(c) for c, _ in choices])
    stay = (u * len(choices) - at) < F.element_at(F.array(*[F.lit(k) for k in keep]), at + 1)
    return F.element_at(names, F.when(stay, at).otherwise(F.element_at(F.array(*[F.lit(o) for o in other]), at + 1)) + 1)


def _one_of(u: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def generate(customer: DataFrame, part: DataFrame, seed: int = 42, sessions_per_user: int = 10,
             events_per_session: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(users, products, sessions, events): one user a customer, one product a part."""
    s = F.lit(seed)

    def draw(name: str, *keys: str) -> Column:
        return uniform(s, F.lit(name), *[F.col(k) for k in keys])

    users = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("plan"), F.col("c_nationkey").alias("country_id"))
    products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).withColumn(
        "category", weighted(draw("category", "product_id"), CATEGORIES)).withColumn("rating", F.round(1 + 4 * draw("rating", "product_id"), 1))

    # the user of rank r has total / (r * (1 + 1/2 + ... + 1/n)) sessions on average
    n = customer.count()
    harmonic = math.log(n) + 0.5772156649 + 0.5 / n if n else 1.0
    rank = F.floor(draw("rank", "user_id") * n) + 1
    n_sess = F.floor(F.lit(n * sessions_per_user / harmonic) / rank + draw("sessions", "user_id"))
    chunks = (users.withColumn("n", n_sess).where("n > 0").select("user_id", "country_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))).alias("chunk"))
              .repartition("user_id", "chunk"))
    one = chunks.select("user_id", "country_id", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK).cast("int"))).alias("sno"))
    start = F.lit("2023-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(draw("start", "user_id", "sno") * 730).cast("int"))
    sessions = one.select(F.concat_ws("-", "user_id", "sno").alias("session_id"), "user_id", "country_id", start.alias("start_time"),
                          (F.floor(draw("duration", "user_id", "sno") * 3600) + 1).cast("int").alias("duration_seconds"),
                          weighted(draw("device", "user_id", "sno"), DEVICES).alias("device_type"))

    n_ev = (F.floor(draw("events", "session_id") * (2 * events_per_session)) + 1).cast("int")
    ev = sessions.select("*", F.explode(F.sequence(F.lit(1), n_ev)).alias("eno"))
    offset = F.floor(draw("offset", "session_id", "eno") * F.col("duration_seconds")).cast("int")
    ev = ev.select(F.concat_ws("-", "session_id", "eno").alias("event_id"), "session_id", "user_id", "device_type", "country_id",
                   weighted(draw("type", "session_id", "eno"), EVENT_MIX).alias("event_type"),
                   (F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset)).alias("timestamp"))
    # the product of a purchase: a place in the numbered products, joined by the place
    numbered = ranked(products.select("product_id"), [F.col("product_id")], row_number="_place")
    m = F.lit(part.count())
    ev = ev.withColumn("_place", F.when(F.col("event_type") == "purchase", (F.floor(draw("product", "event_id") * m) + 1).cast("int"))).join(numbered, "_place", "left").drop("_place")
    props = None
    for kind, names in PROPERTIES.items():
        pairs = [x for name, values in names.items() for x in (F.lit(name), _one_of(draw(name, "event_id"), values))]
        if kind == "purchase":
            pairs += [F.lit("product_id"), F.col("product_id").cast("string"), F.lit("quantity"), (F.floor(draw("quantity", "event_id") * 5) + 1).cast("string"),
                      F.lit("amount"), F.format_string("%.2f", 5 + 495 * draw("amount", "event_id"))]
        value = F.create_map(*pairs)
        props = F.when(F.col("event_type") == kind, value) if props is None else props.when(F.col("event_type") == kind, value)
    return users, products, sessions, ev.withColumn("properties", props).drop("product_id")
