"""Secret scans: base patterns, and sliding-window entropy of candidate strings.

Candidates are runs of CANDIDATE characters. Each belongs to one character class (hex,
letters and digits, base 64), and a window of WINDOW characters moves over it. The window's counts change
by one character in and one out per step, and so does the sum of c * log2(c), from which the
Shannon entropy follows. The allow list suppresses the parts of a candidate that it names; a candidate with a window outside
them whose entropy reaches the limit of its class is a secret.

DataFrame and SQL functions only; every text is worked on in its own row. Spark has no function
for the places of all matches, so the lengths of matches and of the texts between them are
added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import narrow, prepared

ASSIGN = (
    r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# Runs are taken whole, so asking for the least length at once gives the same matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Least highest entropy, in bits per character, by class. Letters alone are words or names unless cases change within them
# and hardly a letter comes twice.
LIMITS = {"hex": 2.8, "letters": 3.9, "alnum": 3.5, "base64": 3.7}
MIXED = "[a-z][A-Z]+[a-z]+[A-Z]"
# Never secrets: placeholders, one repeated character or pair, dates and plain words in a row.
ALLOWED = (
    r"(?i)example|placeholder|changeme|redacted|dummy|your[_-]?(?:key|token|secret)|x{8}|0{8}|1234567890"
    r"|(.)\1{5}|^(..)\2{4}|(?-i:^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_/=-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[_/=-]*$)|^\d{4}-\d\d-\d\d"
)
KINDS = ("assign", "access", "hex", "entropy")


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end, kind, found); end exclusive, code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    return F.when(
        text.rlike(pattern),
        F.aggregate(
            F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("gap")),
            F.struct(
                F.lit(0).alias("at"),
                F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string>>").alias("out"),
            ),
            lambda state, m: F.struct(
                (state["at"] + F.length(m["gap"]) + F.length(m["found"])).alias("at"),
                F.concat(
                    state["out"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(m["gap"])).alias("start"),
                            F.lit(rank).alias("rank"),
                            (state["at"] + F.length(m["gap"]) + F.length(m["found"])).alias("end"),
                            F.lit(kind).alias("kind"),
                            m["found"].alias("found"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda state: state["out"],
        ),
    ).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,found:string>>"))


def class_of(candidate: Column) -> Column:
    """The narrowest character class that holds the whole candidate."""
    return (
        F.when(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(~candidate.rlike("[0-9]"), "letters")
        .when(candidate.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of the windows, bits per character; counts move with the window."""

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def code(i: Column) -> Column:
        return F.ascii(F.substr(candidate, i + 1, F.lit(1)))

    def step(state: Column, i: Column) -> Column:
        inn = code(i)
        out = F.when(i >= window, code(i - window)).otherwise(F.lit(-1))
        moved = inn != out
        c_in, c_out = F.get(state["counts"], inn), F.get(state["counts"], out)
        total = state["total"] + F.when(moved, weight(c_in + 1) - weight(c_in)).otherwise(F.lit(0.0))
        total = total + F.when(moved & (out >= 0), weight(c_out - 1) - weight(c_out)).otherwise(F.lit(0.0))
        counts = F.when(
            moved,
            F.transform(
                state["counts"],
                lambda c, k: c + F.when(k == inn, 1).otherwise(0) - F.when(k == out, 1).otherwise(0),
            ),
        ).otherwise(state["counts"])
        entropy = F.log2(F.lit(float(window))) - total / F.lit(float(window))
        best = F.when(i >= window - 1, F.greatest(state["best"], entropy)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best")
    )
    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), start, step, lambda state: state["best"])


def is_random(candidate: Column) -> Column:
    """Whether a window outside the allowed parts of the candidate reaches the limit of its class."""

    def part_is_random(part: Column) -> Column:
        limit = F.lit(None).cast("double")
        for name, value in LIMITS.items():
            limit = F.when(class_of(part) == name, F.lit(value)).otherwise(limit)
        # Cheap questions first: most candidates are plain words.
        scored = (F.length(part) >= WINDOW) & (part.rlike("[0-9]") | part.rlike(MIXED))
        return F.when(scored, peak_entropy(part) >= limit).otherwise(F.lit(False))

    return F.exists(F.split(candidate, ALLOWED), part_is_random)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) for every row of documents.

    Spans are kind:start:end in code points, end exclusive, sorted by start and then by
    kind as in KINDS; base spans are never dropped, and the method adds spans of kind entropy
    (also where a base span lies). A null or empty text has none; the hash is then that of the
    empty string. A very long text, or run of candidate characters, is scanned whole in its row; its spans are held as a list.
    Ids may be null or repeat. Other columns are not looked at.
    """
    prepared(documents.sparkSession)
    docs = narrow(documents, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    long_value = lambda s: F.length(F.regexp_extract(s["found"], "^" + ASSIGN, 1)) >= 12
    found = docs.select(
        "doc_id",
        F.filter(matches(text, ASSIGN, "assign", 0), long_value).alias("assign"),
        matches(text, ACCESS, "access", 1).alias("access"),
        matches(text, HEX, "hex", 2).alias("hex"),
        F.filter(matches(text, CANDIDATE, "entropy", 3), lambda s: is_random(s["found"])).alias("entropy"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    every = F.array_sort(F.concat("assign", "access", "hex", "entropy"))
    return found.select("doc_id", base.alias("base"), every.alias("every")).select(
        "doc_id",
        _count(F.col("base"), "assign").alias("n_assign"),
        _count(F.col("base"), "access").alias("n_access"),
        _count(F.col("base"), "hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
        _count(F.col("every"), "entropy").alias("n_entropy"),
    )
