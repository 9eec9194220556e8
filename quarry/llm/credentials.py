"""Secret scans with multipart credential linking.

Strong findings stand alone: long assigned secrets, access key ids, long hex runs. Weak parts
(an account name, a short password, an address) say little by themselves; they are reported only
where complementary parts co-occur. Every part is an interval of code points in its scope, a run
of lines without a blank line; it is joined with the complementary parts whose intervals come
within REACH of its own. The join is a sweep over the scope's intervals in order, once forward
and once backward, that carries the nearest end of every role: one row per part, never a pair.

- a weak access identifier is reported within reach of a secret, weak or strong;
- a weak secret is reported within reach of an access identifier, weak or strong;
- an endpoint is reported within reach of both.
A weak part that overlaps a strong finding is left to that.

Offsets come from the texts between the matches: their lengths and the matches' lengths, summed
in order. Built-in functions only. One shuffle, of the parts without text, by document.

Defined cases: a null or empty text has no parts; a text is scanned whole, whatever its length;
rows with equal doc_id and text are scanned once and returned as often as they came; equal
intervals of several kinds are all reported; an empty table gives an empty table; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import let, text_of

#: Code points between parts that belong together.
REACH = 400
VALUE = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value (0: all), the least lengths of strong and weak findings, the role."""

    name: str
    pattern: str
    group: int
    strong: int
    weak: int
    role: str


NEVER = 1 << 30
KINDS = (
    Kind("assign", r"(?i)(password|passwd|secret|token|api_?key)" + VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 12, 6, "secret"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, NEVER, "access"),
    # a run of 16 or more is the only match of the plain run that can pass, so shorter runs are passed over by the pattern
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, NEVER, "secret"),
    Kind("weak_access", r"(?i)\b(user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)" + VALUE + r"([A-Za-z0-9@+/_.-]+)", 2, NEVER, 3, "access"),
    Kind("weak_secret", r"(?i)\b(pwd|pass|passphrase|credentials?|private_?key|auth(?:orization)?|bearer)" + VALUE + r"([A-Za-z0-9+/_.=!@#%-]+)", 2, NEVER, 6, "secret"),
    Kind("weak_endpoint", r"""(?i)\b(?:https?|ftps?|ssh|s3|redis|amqps?|mysql|postgres(?:ql)?|mongodb(?:\+srv)?|jdbc:[a-z0-9]+)://[^\x20\x09-\x0D"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+""", 0, NEVER, 6, "endpoint"),
)
BREAK, ROW = "break", "row"
ROLES = ("access", "secret", "endpoint")
WEAK_SECRET = [k.name for k in KINDS].index("weak_secret")
BASE = tuple(k.name for k in KINDS if k.strong < NEVER)
KEY = ["doc_id", "th"]


def matches(text: Column, number: int, pattern: str, group: int = 0) -> Column:
    """Structs (kind, pos, gap, len, value) of the pattern's matches: gap is the text before, since the match before."""
    found = let(
        F.split(text, pattern, -1),
        lambda between: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
            lambda values: F.transform(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("pos"), F.length(between[i]).alias("gap"), F.length(m).alias("len"), F.length(values[i]).alias("value")),
            ),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,value:int>>"))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, copies, kind, start, end, value) of every match, and a row of kind -1 for every document."""
    found = [matches(text_of(), i, k.pattern, k.group) for i, k in enumerate(KINDS)]
    breaks = matches(text_of(), len(KINDS), r"\n[\x20\x09\x0B-\x0D]*(?=\n)")
    weak = F.array_contains(F.transform(F.col("found"), lambda p: p["kind"].isin([i for i, k in enumerate(KINDS) if k.weak < NEVER])), True)
    marker = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(0).alias("value")))
    thin = (
        docs.select("doc_id", "text")
        .withColumn("th", F.xxhash64(text_of()))
        .withColumn("found", F.concat(*found))
        .select(*KEY, F.concat(marker, "found", F.when(weak, breaks).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,value:int>>"))).alias("parts"))
    )
    # copies of a row are one row of each task before the shuffle
    once = thin.groupBy(*KEY).agg(F.first("parts").alias("parts"), F.count("*").alias("copies")).select(*KEY, "copies", F.explode("parts").alias("p")).select(*KEY, "copies", "p.*")
    so_far = Window.partitionBy(*KEY, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    return once.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))


def findings(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans): array<struct<start, kind, end, name>> by start, then kind as listed."""
    number = F.col("kind")

    def by_kind(get) -> Column:
        return F.coalesce(*[F.when(number == i, get(k)) for i, k in enumerate(KINDS)])

    strong = F.coalesce(F.col("value") >= by_kind(lambda k: F.lit(k.strong)), F.lit(False))
    weak = ~strong & F.coalesce(F.col("value") >= by_kind(lambda k: F.lit(k.weak)), F.lit(False))
    role = F.when(strong | weak, by_kind(lambda k: F.lit(k.role)))
    rows = parts(docs).withColumns({"strong": strong, "weak": weak, "role": role}).filter(F.col("strong") | F.col("weak") | (number == len(KINDS)) | (number == -1))

    order = [F.col("start"), F.col("kind")]
    whole = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum((number == len(KINDS)).cast("int")).over(whole))
    ahead = Window.partitionBy(*KEY, "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*KEY, "scope").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(what: Column) -> Column:
        before = F.col("start") - F.max(F.when(what, F.col("end"))).over(ahead)
        after = F.min(F.when(what, F.col("start"))).over(back) - F.col("end")
        return F.coalesce(F.least(before, after) <= reach, F.lit(False))

    covered = F.coalesce(F.max(F.when(F.col("strong"), F.col("end"))).over(ahead) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("strong"), F.col("start"))).over(back) < F.col("end"), F.lit(False))
    rows = rows.withColumns({"covered": covered, **{f"near_{r}": near(F.col("role") == r) for r in ROLES[:2]}})
    linked = (F.when(F.col("role") == "access", F.col("near_secret")).when(F.col("role") == "secret", F.col("near_access")).otherwise(F.col("near_access") & F.col("near_secret"))) & ~F.col("covered")
    named_as = F.when(weak & (number == 0), WEAK_SECRET).otherwise(number)  # a short assigned value is a weak secret
    span = F.struct(F.col("start").cast("long").alias("start"), named_as.alias("kind"), F.col("end").cast("long").alias("end"), F.get(F.array(*[F.lit(k.name) for k in KINDS]), named_as).alias("name"))
    report = F.when((number >= 0) & (number < len(KINDS)) & (F.col("strong") | linked), span)
    done = rows.withColumn("span", report).groupBy(*KEY).agg(F.array_sort(F.collect_set("span")).alias("spans"), F.max(F.when(number == -1, F.col("copies"))).cast("int").alias("copies"))
    return done.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "spans")


def named(name: str) -> Callable[[Column], Column]:
    return lambda span: span["name"] == name


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
