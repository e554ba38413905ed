"""Secret scan: candidates by patterns, false positives removed by a random forest, with DataFrame functions only.

A candidate is the value of an assignment, a token of a provider's format, a private key block, or a long unbroken run of token
characters. Features: length, shares of character classes, transitions between classes, distinct characters, coverage
by the corpus's own common words, whether it stands in a path or address, and neighbouring words that speak of secrets or of
examples. The forest learns from labelled findings; where none are given, findings are labelled by rules that only cover
clear cases (a provider's format or a random value assigned to a secret's name, against plain words, placeholders, counters
and paths), and the forest decides the rest by the features alone. The sample it learns from is bounded by SAMPLE.

Dictionary words are counted over all documents: those in at least WORD_SHARE of them, and in WORD_DOCS at the least, of
which the WORDS most frequent ones bound the dictionary.

Defined cases: null and empty texts have no findings; a table without clear cases of both kinds gives findings whose score
is the rule's verdict; rows that repeat are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

SAMPLE = 20_000
WORDS = 2_000
WORD_SHARE = 0.001  # of the documents that hold a word of the dictionary
WORD_DOCS = 5  # in fewer documents a word isn't common, however small the table
FOLD = 256  # candidates of a text that are placed at once
AROUND = 60  # characters of context on either side
TREES, DEPTH = 25, 7
KEEP = 0.5
_PLACES = 1 << 20

#: Formats of well-known providers' credentials; fixed values.
FORMATS = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9A-Za-z]{16,}|glpat-[A-Za-z0-9_\-]{20}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,}"
BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END [A-Z ]{0,20}PRIVATE KEY-----"
NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer"
ASSIGNED = rf"(?i:(?<![a-z])(?:[a-z0-9_\-]{{0,200}})(?:{NAMES})(?:[a-z0-9_\-]{{0,200}}+)[\"']?\s{{0,3}}(?:=|:=|:|=>)\s{{0,3}}[\"']?)([A-Za-z0-9+/=_\-.!@#$%^&*]{{8,}})"
LONG = r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{20,}(?![A-Za-z0-9+/=_\-])"
ANY = f"{BLOCK}|{FORMATS}|{ASSIGNED}|{LONG}"
#: Found in every text that holds a match of ANY: a cheap test before it.
MAYBE = rf"[A-Za-z0-9+/=_\-]{{20}}|PRIVATE KEY|xox[abprs]-|eyJ|(?i:(?:{NAMES})[a-z0-9_\-]{{0,200}}+)[\"']?\s{{0,3}}[=:]"
EXAMPLES = "example|sample|placeholder|dummy|changeme|your[_-]|xxxx|test|fake|todo|redacted"

FEATURES = ["size", "upper", "lower", "digit", "sign", "turns", "distinct", "hex", "words", "longest", "named", "quoted", "format", "in_path", "near_secret", "near_example"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the candidate in its text, in characters from 1), rule, value, before, after."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(MAYBE))
    text = text.withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).where(F.size("found") > 0)
    gaps = F.split("text", ANY, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size("found")), "found", lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m")))
    # running sums chunk by chunk: no array that grows is longer than FOLD, or than the number of chunks
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("found") / FOLD).cast("int") - 1), lambda k: F.slice(sizes, k * FOLD + 1, F.lit(FOLD)))
    none = F.array().cast("array<int>")

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["all"], F.array(a["at"] + x["g"])).alias("all"))

    def chunk(a: Column, c: Column) -> Column:
        begin = F.struct(a["at"].alias("at"), none.alias("all"))
        return F.aggregate(c, begin, step, lambda s: F.struct(s["at"].alias("at"), F.concat(a["all"], F.array(s["all"])).alias("all")))

    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<array<int>>").alias("all"))
    placed = F.aggregate(chunks, begin, chunk, lambda a: F.flatten(a["all"]))
    both = F.arrays_zip(placed.alias("at"), F.col("found").alias("m"), F.slice(gaps, 1, F.size("found")).alias("l"), F.slice(gaps, 2, F.size("found")).alias("r"))
    rows = text.select("doc_id", F.explode(both).alias("x")).select("doc_id", F.col("x.at").alias("at"), F.col("x.m").alias("match"), F.col("x.l").alias("l"), F.col("x.r").alias("r"))
    inner = F.regexp_extract("match", f"^{ASSIGNED}$", 1)
    value = F.when(F.col("match").startswith("-----BEGIN"), F.col("match")).when(inner != "", inner).otherwise(F.col("match"))
    rows = rows.withColumn("value", value)
    rule = F.when(F.col("match").startswith("-----BEGIN"), "private_key").when(F.col("value").rlike(f"^(?:{FORMATS})$"), "format").when(inner != "", "assigned").otherwise("long")
    lead = F.char_length("match") - F.char_length("value")
    return rows.select(
        "doc_id",
        (F.col("at") + F.when(inner != "", lead).otherwise(0)).cast("long").alias("place"),
        rule.alias("rule"),
        "value",
        F.concat(F.right("l", F.lit(AROUND)), F.when(inner != "", F.left("match", lead)).otherwise("")).alias("before"),
        F.left("r", F.lit(AROUND)).alias("after"),
    )


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent words of 4 to 12 letters, by the documents that hold them."""
    least = max(WORD_DOCS, math.ceil(WORD_SHARE * docs.count()))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{4,12}"), F.lit(0)))).alias("w"))
    top = words.groupBy("w").count().where(F.col("count") >= least).orderBy(F.desc("count"), "w").limit(WORDS).collect()
    return [r["w"] for r in top]


def any_word(words: list[str]) -> str:
    """A pattern of all the words that tries each letter once: the longest word at a place matches. Words are letters only."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        more = [c + write(n) for c, n in sorted(node.items()) if c]
        if not more:
            return ""
        return f"(?:{'|'.join(more)})" + ("?" if "" in node else "")

    return write(root)


def _share(value: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(value, pattern, "")) / F.char_length(value)


def features(found: DataFrame, words: list[str]) -> DataFrame:
    v = F.col("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s")
    runs = F.regexp_replace(classes, r"(.)\1+", "$1")
    runs_of_letters = F.regexp_extract_all(F.lower(v), F.lit(r"\p{L}{4,}"), F.lit(0))
    cover = F.regexp_replace(F.lower(v), any_word(words), "") if words else F.lower(v)
    out = found.withColumns(
        {
            "size": F.log1p(F.char_length(v)),
            "upper": _share(v, "[^A-Z]"),
            "lower": _share(v, "[^a-z]"),
            "digit": _share(v, "[^0-9]"),
            "sign": _share(v, "[A-Za-z0-9]"),
            "turns": F.char_length(runs) / F.char_length(v),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.char_length(v), F.lit(64)),
            "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
            "words": 1 - F.char_length(cover) / F.char_length(v),
            "longest": F.coalesce(F.array_max(F.transform(runs_of_letters, lambda w: F.char_length(w))), F.lit(0)) / F.char_length(v),
            "named": (F.col("rule") == "assigned").cast("double"),
            "quoted": F.col("before").rlike("[\"'`]$").cast("double"),
            "format": F.col("rule").isin("format", "private_key").cast("double"),
            "in_path": (F.col("before").rlike(r"(?:https?:|[/\\.@])\S*$") | v.rlike("/.*/")).cast("double"),
            "near_secret": F.concat_ws(" ", "before", "after").rlike(f"(?i){NAMES}").cast("double"),
            "near_example": F.concat_ws(" ", "before", "value", "after").rlike(f"(?i){EXAMPLES}").cast("double"),
        }
    )
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def clear_cases(found: DataFrame) -> Column:
    """1 or 0 where a rule is sure, else null."""
    random = (F.col("distinct") > 0.15) & (F.col("turns") > 0.25) & (F.col("words") < 0.5) & (F.col("size") > math.log1p(15))
    return (
        F.when(F.col("near_example") == 1, 0)
        .when(F.col("format") == 1, 1)
        .when((F.col("named") == 1) & random & (F.col("in_path") == 0), 1)
        .when(F.col("digit") == 0, 0)
        .when((F.col("digit") == 1) | (F.col("distinct") < 0.12) | (F.col("in_path") == 1), 0)
        .when(F.col("words") > 0.6, 0)
    )


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """A row for each candidate: doc_id, place, rule, value_sha256, size, score, kept.

    labelled: findings with the columns of candidates() and `label` (0 or 1); without it, the clear cases are used.
    """
    words = dictionary(docs)
    found = durable(features(candidates(docs), words))
    if labelled is None:
        sure = found.withColumn("label", clear_cases(found)).where("label IS NOT NULL")
    else:
        sure = features(labelled, words).where("label IS NOT NULL")
    each = {r["label"]: r["count"] for r in sure.groupBy("label").count().collect()}
    verdict = F.coalesce(clear_cases(found), F.lit(0)).cast("double")
    if len(each) == 2:
        # half of the sample of either kind, chosen by the values' hash
        kept = F.lit(False)
        for label, n in each.items():
            kept = kept | (F.col("label") == label) & (F.pmod(F.xxhash64("value", "doc_id", "place"), F.lit(_PLACES)) < math.ceil(sample / 2 / n * _PLACES))
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="vector")
        train = durable(sure.where(kept).orderBy("label", "value", "doc_id", "place").select(F.col("label").cast("double").alias("label"), *FEATURES))
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt")
        model = forest.fit(assemble.transform(train))
        seen = model.transform(assemble.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        seen = found.withColumn("score", verdict)
    return seen.select("doc_id", "place", "rule", F.sha2("value", 256).alias("value_sha256"), F.char_length("value").alias("n_chars"), "score", (F.col("score") >= KEEP).alias("kept"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
