"""License scan: MinHash bands over overlapping windows retrieve templates, then exact containment.

Built-in functions only. Texts and templates become hashes of shingles of ``SHINGLE``
words (A-Z lower-cased, without the marks ``.,;:!?"()``). For a template of ``s`` shingles
the windows have ``s + step - 1`` shingles and start every ``step = max(1, s // 4)``, so
every occurrence lies whole in a window.

The shingles of the texts meet those of all templates in a broadcast join, and only what is found
goes on: a window is the set of its shingles that templates of its length have. That loses
nothing, as other shingles are in no template, and it makes windows only more similar to their
template. Windows are retrieved by ``BANDS`` bands of ``ROWS`` min-hashes; at the least
similarity that a match can have (0.55), a band meets with a probability of 0.3 and all bands
miss with 1e-5. A match is verified exactly: the window holds at least ``CONTAINMENT`` of the
template's shingles. The work for a word does not depend on the length of the templates.

One row per document and template found: the best window's containment, and the first word
of the earliest window that has it. Templates are a parameter of at most ``TEMPLATES_MOST``
rows and ``SHINGLES_MOST`` shingles in all. Null and empty texts, and texts shorter than a shingle,
match nothing. Rows of one id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.llm.license_texts import TEMPLATES
from sentspark.session import ship_package

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 32, 2
# Most templates, and most shingles of all of them: these are broadcast.
TEMPLATES_MOST = 1000
SHINGLES_MOST = 1_000_000

_GAP = "[\\x20\\x09-\\x0D]+"
_MARKS = '.,;:!?"()'
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(text: Column) -> Column:
    """Hashes of the shingles of a text, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _LOWER)
    words = F.filter(F.split(plain, _GAP), lambda w: w != "")

    def hashed(w: Column) -> Column:
        return F.when(
            F.size(w) >= SHINGLE,
            F.transform(
                F.slice(w, F.lit(1), F.size(w) - (SHINGLE - 1)),
                lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), hashed)[0]


def _bands(values: Column) -> Column:
    """Keys of the bands of a set of shingles."""

    def least_of(k: int) -> Column:
        return F.array_min(F.transform(values, lambda x: F.xxhash64(x, F.lit(k))))

    least = [least_of(k) for k in range(BANDS * ROWS)]
    return F.array(*(F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license``, its distinct shingles and their number ``s``."""
    words = sum(len(t.split()) for t in templates.values())
    if len(templates) > TEMPLATES_MOST or words > SHINGLES_MOST:
        raise ValueError(
            f"at most {TEMPLATES_MOST} templates of {SHINGLES_MOST} words, not {len(templates)} of {words}"
        )
    rows = spark.createDataFrame(sorted(templates.items()), "license string, words string")
    shingles = F.array_distinct(_shingles(F.col("words")))
    return rows.select("license", shingles.alias("template")).withColumn("s", F.size("template")).filter("s > 0")


def _step(s: Column | int):
    return F.greatest(F.lit(1), F.floor(s / 4)).cast("int")


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, ``license``, ``containment``, ``first_word`` of every match."""
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    known = known.withColumn("step", _step(F.col("s")))
    index = known.select("s", "step", F.explode("template").alias("shingle")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shingles(F.col("text")).alias("shingles"))
    # numbers of rows of a scan are the same when a task is run again
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    places = numbered.select("doc_id", "row", F.posexplode("shingles").alias("i", "shingle"))
    hits = places.join(F.broadcast(index), "shingle")

    width, step = F.col("s") + F.col("step") - 1, F.col("step")
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / step) * step).cast("int")
    starts = F.sequence(low, F.floor(F.col("i") / step).cast("int") * step, step)
    # a group holds at most the shingles of a window
    windows = (
        hits.select("doc_id", "row", "s", "shingle", F.explode(starts).alias("p"))
        .groupBy("doc_id", "row", "s", "p")
        .agg(F.collect_set("shingle").alias("window"))
    )
    keyed = windows.withColumn("bands", _bands(F.col("window"))).select("*", F.posexplode("bands").alias("band", "key"))
    bands = known.select("license", "s", _bands(F.col("template")).alias("own"))
    found = keyed.join(F.broadcast(bands.select("*", F.posexplode("own").alias("band", "key"))), ["s", "band", "key"])
    # a pair that meets in several bands is verified once, at the first of them
    same = F.zip_with("bands", "own", lambda x, y: x == y)
    found = found.filter(F.array_position(same, True) == F.col("band") + 1)
    found = found.select("doc_id", "license", "p", "window").join(F.broadcast(known.select("license", "s", "template")), "license")
    share = F.size(F.array_intersect("template", "window")) / F.col("s")
    found = found.withColumn("containment", share).filter(F.col("containment") >= CONTAINMENT)
    best = found.groupBy("doc_id", "license").agg(
        F.max(F.struct("containment", (-F.col("p").cast("long")).alias("p"))).alias("best")
    )
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.p")).alias("first_word"))


def _oracle() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in TEMPLATES.items())
    plain = f"translate(coalesce({{}}, ''), '{_UPPER}{_MARKS}', '{_LOWER}')"
    words = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    cut = "array_to_string(w[i:i + 4], ' ')"
    return f"""
with t as (select license, {words.format(plain.format('body'))} as w from (values {values}) v(license, body)),
ts as (select distinct license, {cut} as sh from (select *, unnest(range(1, len(w) - 3)) as i from t where len(w) >= 5) x),
n as (select license, count(*) as s, greatest(1, count(*) // 4) as step from ts group by license),
d as (select doc_id, {words.format(plain.format('text'))} as w from documents),
places as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) - 1 as i, rid from (select *, row_number() over () as rid from d) x),
g as (select doc_id, rid, i, a || ' ' || lead(a) over o || ' ' || lead(a, 2) over o || ' ' || lead(a, 3) over o || ' ' || lead(a, 4) over o as sh
  from places window o as (partition by rid order by i)),
h as (select g.doc_id, rid, i, sh, license, s, step from g join ts using (sh) join n using (license)),
w as (select doc_id, rid, license, s, sh,
  unnest(range(greatest(0, cast(ceil((i - (s + step - 1) + 1) / step) as bigint) * step), (i // step) * step + 1, step)) as p from h),
c as (select doc_id, rid, license, p, count(distinct sh) / s as containment from w group by doc_id, rid, license, p, s),
b as (select *, row_number() over (partition by doc_id, license order by containment desc, p) as r from c where containment >= {CONTAINMENT})
select doc_id, license, containment, cast(p as bigint) as first_word from b where r = 1"""


@query("op1_license_scan", _oracle())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return license_matches(table(spark, sf_dir, "documents"))
