"""Quality rules: base rules, then robust multivariate outliers per language and source.

Built-in functions only. One pass over the text computes the counts of every document in
its row. The rest works on a narrow table of integers, one row per document:

* A document's vector has four statistics in thousandths: the log of the mean word length,
  the square root of the share of symbols, the share of lines that repeat an earlier one,
  and the share of words in repeated three-word windows.
* Documents of one language and source form a group. Sources with fewer than ``MIN_GROUP``
  documents that pass the base rules form one group per language, and languages that are
  still smaller form one group together.
* Each group's minimum-covariance-determinant estimate: from three starts (the quartiles of
  every statistic), ``STEPS`` concentration steps take mean and covariance of the nearest half
  of the documents; the estimate of the least determinant is taken. Junk of nearly half a
  group does not move it.
* A document is rejected when its squared Mahalanobis distance exceeds ``CUTOFF``.

A step is one statement over the narrow table: documents are counted and summed by group,
start and rounded distance, so what leaves a task is bounded by the number of distances
(``FAR``), however large a group is. Buckets are added up from the nearest until half of the
group is reached; the bucket that passes half counts with the share that is missing, so
half counts however many copies lie there.

Sums are sums of integers, so results do not depend on the partitioning. Covariances get
``SPREAD`` squared on the diagonal: a statistic that is nearly constant in a group does
not make small deviations from it outliers.

Null text has no words; fewer than 50 words fail the base rules. A null language or
source is a value like any other. Repeated rows are judged alike, one result for each.
Three-word windows of a document are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.session import ship_package
from sentspark.storage import materialise

MIN_GROUP = 50
#: Concentration steps from each start; later steps of a stable estimate change nothing.
STEPS = 6
#: Quantiles of the statistics at which the starts lie.
STARTS = (0.5, 0.25, 0.75)
#: 0.9999 quantile of the chi-squared distribution with 4 degrees of freedom.
CUTOFF = 23.5127
#: Makes the covariance of the nearest half consistent for a normal vector in 4 dimensions.
CONSISTENCY = 2.1090
#: Least spread of each statistic, in thousandths.
SPREAD = (50, 50, 100, 100)
#: Sixteenths of a squared distance from which documents count as equally far.
FAR = 16000

_GAP = "[\\x20\\x09-\\x0D]+"
_GAPS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words covered by a three-word window that is found twice or more."""

    def marked(windows: Column) -> Column:
        n = F.size(windows)
        again = F.filter(
            windows,
            lambda x, i: ((i > 0) & (x["h"] == F.get(windows, i - 1)["h"]))
            | ((i < n - 1) & (x["h"] == F.get(windows, i + 1)["h"])),
        )
        return _let(F.sort_array(F.transform(again, lambda x: x["p"])), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def ordered(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _let(F.sort_array(pairs), marked)
        )

    hashes = F.transform(
        F.slice(words, F.lit(1), F.size(words) - 2),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, ordered))


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``lang`` and ``source`` without nulls, and
    the struct ``counts`` of every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_GAPS)) != "")
    long = lambda c: c.cast("long")
    counts = _let(
        F.struct(t.alias("t"), words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            long(F.size(x["w"])).alias("n_words"),
            long(F.char_length(F.regexp_replace(x["t"], _GAP, ""))).alias("word_chars"),
            long(F.char_length(x["t"]) - F.char_length(F.translate(x["t"], _SYMBOLS, ""))).alias("n_symbols"),
            long(F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).alias("n_dup_lines"),
            _repeated(x["w"]).alias("n_repeat_words"),
            long(F.size(x["l"])).alias("n_lines"),
        ),
    )
    row = F.struct(*(F.col(f"`{c}`") for c in keep))
    return docs.select(row.alias("row"), *(_name(c).alias(c) for c in ("lang", "source")), counts.alias("counts"))


# The statements below are written in SQL that Spark and DuckDB read alike; the oracle is
# made of the same statements, over counts that it derives in its own way.

BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

_VECTOR = (
    "cast(round(1000 * ln(word_chars / cast(n_words as double))) as bigint)",
    "cast(round(1000 * sqrt(n_symbols / cast(word_chars as double))) as bigint)",
    "cast(round(1000 * (n_dup_lines / cast(n_lines as double))) as bigint)",
    "cast(round(1000 * (n_repeat_words / cast(n_words as double))) as bigint)",
)
_AXES = range(len(_VECTOR))

#: Counts of the documents, to their vectors; ``lang`` and ``source`` without nulls.
_VECTORS = (
    "select lang, source, "
    + ", ".join(f"{v} as x{i}" for i, v in enumerate(_VECTOR))
    + f" from counts where not ({BASE_FAILED})"
)

_GROUPS = f"""
select lang, source,
  case when n >= {MIN_GROUP} then lang || chr(10) || source
       when sum(case when n >= {MIN_GROUP} then 0 else n end) over (partition by lang) >= {MIN_GROUP} then lang || chr(10)
       else chr(10) end as grp
from (select lang, source, count(*) as n from vectors group by lang, source) x"""

_MEMBERS = """select g.grp, v.* from vectors v join groups g on v.lang = g.lang and v.source = g.source"""

_PAIRS = [(i, j) for i in _AXES for j in range(i + 1)]

_QUANTILES = (
    "select grp, count(*) as size, "
    + ", ".join(
        f"cast(percentile_disc({q}) within group (order by x{i}) as double) as q{k}{i}"
        for k, q in enumerate(STARTS)
        for i in _AXES
    )
    + " from members group by grp"
)

#: An estimate has a mean ``m`` and the inverse ``k`` of the covariance's Cholesky factor.
_START = " union all ".join(
    f"select grp, size, {k} as start, "
    + ", ".join(f"q{k}{i} as m{i}" for i in _AXES)
    + ", "
    + ", ".join(f"cast({1 / SPREAD[i] if i == j else 0} as double) as k{i}{j}" for i, j in _PAIRS)
    + ", cast(0 as double) as det from quantiles"
    for k in range(len(STARTS))
)


def _distance(x: str = "v", p: str = "p") -> str:
    """Squared Mahalanobis distance."""
    terms = [" + ".join(f"{p}.k{i}{j} * ({x}.x{j} - {p}.m{j})" for j in range(i + 1)) for i in _AXES]
    return " + ".join(f"({z}) * ({z})" for z in terms)


_SUMMED = {f"s{i}": f"x{i}" for i in _AXES} | {f"s{i}{j}": f"x{i} * x{j}" for i, j in _PAIRS}

#: Documents of every group, start and distance, with their sums.
_BUCKETS = (
    "select grp, start, size, near, count(*) as n, "
    + ", ".join(f"sum({x}) as {s}" for s, x in _SUMMED.items())
    + f" from (select v.*, p.start, p.size, cast(floor(least(16 * ({_distance()}), {FAR}.0)) as bigint) as near"
    + " from members v join params p on v.grp = p.grp) x group by grp, start, size, near"
)


def _step() -> str:
    """From the buckets to the means and the inverse Cholesky factor, one entry a level."""
    full, last = "before + n <= half", "before < half and before + n > half"
    sums = (
        "select grp, start, size, half, coalesce(max(case when " + last + " then (half - before) / n end), 0) as share, "
        + ", ".join(
            f"cast(sum(case when {full} then {s} else 0 end) as double) as a{s}, "
            f"cast(sum(case when {last} then {s} else 0 end) as double) as b{s}"
            for s in _SUMMED
        )
        + " from (select *, size / cast(2 as double) as half, cast(sum(n) over (partition by grp, start order by near) - n"
        + " as double) as before from buckets) x group by grp, start, size, half"
    )
    means = (
        "select grp, start, size, "
        + ", ".join(f"(a{s} + share * b{s}) / half as {'m' + s[1:] if len(s) == 2 else s}" for s in _SUMMED)
        + f" from ({sums}) x"
    )
    inner = (
        "select grp, start, size, "
        + ", ".join(f"m{i}" for i in _AXES)
        + ", "
        + ", ".join(
            f"(s{i}{j} - m{i} * m{j}) * {CONSISTENCY}" + (f" + {SPREAD[i] ** 2}" if i == j else "") + f" as c{i}{j}"
            for i, j in _PAIRS
        )
        + f" from ({means}) x"
    )
    for i, j in _PAIRS:
        less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        entry = f"sqrt(c{i}{i}{less})" if i == j else f"(c{i}{j}{less}) / l{j}{j}"
        inner = f"select *, {entry} as l{i}{j} from ({inner}) f{i}{j}"
    for i in _AXES:
        entries = [
            f"1 / l{i}{i} as k{i}{j}" if i == j else f"-({' + '.join(f'l{i}{k} * k{k}{j}' for k in range(j, i))}) / l{i}{i} as k{i}{j}"
            for j in range(i + 1)
        ]
        inner = f"select *, {', '.join(entries)} from ({inner}) k{i}"
    keep = ["grp", "size", "start", *(f"m{i}" for i in _AXES), *(f"k{i}{j}" for i, j in _PAIRS)]
    return f"select {', '.join(keep)}, {' * '.join(f'l{i}{i}' for i in _AXES)} as det from ({inner}) f"


_STEP = _step()

_LEAST = "select * from (select *, row_number() over (partition by grp order by det, start) as place from params) x where place = 1"


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\x01"))


def _over(statement: str, **tables: DataFrame) -> DataFrame:
    """A statement over DataFrames in place of the tables it names."""
    spark = next(iter(tables.values())).sparkSession
    for name in tables:
        statement = statement.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    return spark.sql(statement, **tables)


def estimates(counts: DataFrame) -> DataFrame:
    """Mean and inverse Cholesky factor of every (lang, source) among ``counts``.

    ``counts`` has ``lang`` and ``source`` without nulls and the counts of each document.
    """
    vectors = _over(_VECTORS, counts=counts)
    groups = materialise(_over(_GROUPS, vectors=vectors), "quality-groups")
    members = materialise(_over(_MEMBERS, vectors=vectors, groups=groups), "quality-members")
    params = _over(_START, quantiles=materialise(_over(_QUANTILES, members=members), "quality-quantiles"))
    for _ in range(STEPS):
        params = materialise(params, "quality-params")
        params = _over(_STEP, buckets=_over(_BUCKETS, members=members, params=params))
    # written, so that its size is known where it is joined
    return materialise(groups.join(_over(_LEAST, params=params), "grp").drop("grp", "size", "start", "place"), "quality-estimates")


def judged(counted: DataFrame) -> DataFrame:
    """``row``, ``counts``, ``base_failed`` and ``kept`` of the documents of :func:`with_counts`."""
    params = estimates(counted.select("lang", "source", "counts.*"))
    p = params.select(
        F.struct(*(c for c in params.columns if c not in ("lang", "source"))).alias("p"),
        F.col("lang").alias("p_lang"),
        F.col("source").alias("p_source"),
    )
    joined = counted.join(p, (F.col("lang") == F.col("p_lang")) & (F.col("source") == F.col("p_source")), "left")
    vector = F.expr("named_struct(" + ", ".join(f"'x{i}', {_in_counts(v)}" for i, v in enumerate(_VECTOR)) + ")")
    joined = joined.withColumn("base_failed", F.expr(_in_counts(BASE_FAILED)))
    joined = joined.withColumn("v", F.when(~F.col("base_failed"), vector))
    near = F.coalesce(F.expr(f"{_distance()} <= {CUTOFF}"), F.lit(True))
    return joined.select("row", "counts", "base_failed", (~F.col("base_failed") & near).alias("kept"))


def _in_counts(expression: str) -> str:
    for c in _COUNTS:
        expression = expression.replace(c, f"counts.{c}")
    return expression


def quality_filter(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents, in the same columns.

    The documents are written once with their counts, which cost more than the writing.
    """
    counted = materialise(with_counts(docs, docs.columns), "quality-documents")
    return judged(counted).filter("kept").select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    result = judged(materialise(with_counts(docs, ["doc_id"]), "quality-counts"))
    return result.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        *(F.col("counts")[c].alias(c) for c in _COUNTS[:5]),
        "base_failed",
        "kept",
    )


def _oracle() -> str:
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    lines = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    steps = [
        f"""docs as (select doc_id, coalesce(lang, chr(1)) as lang, coalesce(source, chr(1)) as source, coalesce(text, '') as t,
  row_number() over () as rid from documents)""",
        f"""parts as (select rid, doc_id, lang, source, t, {words} as w, {lines} as l from docs)""",
        """places as (select rid, unnest(w) as a, generate_subscripts(w, 1) as p from parts)""",
        """windows as (select rid, p, a, lead(a) over o as b, lead(a, 2) over o as c from places
  window o as (partition by rid order by p))""",
        """twice as (select rid, unnest([p, p + 1, p + 2]) as p from
  (select rid, p, count(*) over (partition by rid, a, b, c) as n from windows where c is not null) x where n > 1)""",
        """again as (select rid, count(distinct p) as n from twice group by rid)""",
        r"""counts as materialized (select rid, doc_id, lang, source, cast(len(w) as bigint) as n_words,
  cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words,
  cast(len(l) as bigint) as n_lines from parts left join again using (rid))""",
        f"vectors as materialized ({_VECTORS})",
        f"groups as materialized ({_GROUPS})",
        f"members as materialized ({_MEMBERS})",
        f"quantiles as materialized ({_QUANTILES})",
        f"params0 as materialized ({_START})",
    ]
    for k in range(STEPS):
        steps += [
            f"buckets{k} as materialized ({_BUCKETS.replace('join params p', f'join params{k} p')})",
            f"params{k + 1} as materialized ({_STEP.replace('from buckets', f'from buckets{k}')})",
        ]
    vectors = ", ".join(f"case when {BASE_FAILED} then null else {v} end as x{i}" for i, v in enumerate(_VECTOR))
    return f"""with {', '.join(steps)}, least as ({_LEAST.replace('from params', f'from params{STEPS}')})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} as base_failed,
  not ({BASE_FAILED}) and coalesce({_distance()} <= {CUTOFF}, true) as kept
from (select *, {vectors} from counts) v left join groups g on v.lang = g.lang and v.source = g.source
left join least p on g.grp = p.grp"""


@query("op10_quality_outliers", _oracle())
def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_report(table(spark, sf_dir, "documents"))
