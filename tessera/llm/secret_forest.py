"""Operator 6: secret scan with a random forest against false positives (DataFrame functions and MLlib).

Candidates are all words of every text that could hold a credential: ``MIN_LENGTH``
characters or more with a digit, or 16 or more capitals in a row. Each has features
that say nothing about a vendor's format:

* length; share of digits, capitals and other marks;
* character transitions (changes of class between neighbouring characters, over the length);
* dictionary coverage: the share of its letters in runs that are words of the corpus;
* path: whether the document's path looks like tests, samples or docs, and its depth;
* neighbouring words: credential words and assignment marks in the two words before, in
  the candidate and after it, quotes, and the mean length of the neighbours.

A random forest learns from labelled findings (columns value, label) and scores all
candidates; those under ``THRESHOLD`` are dropped as false positives. It is fitted on a
bounded, documented sample (of each label the ``TRAIN_ROWS`` rows with the smallest
hash, so a rare label is not crowded out); everything else covers all rows. The fit
sorts that sample, so reruns agree.

Dictionary counts come from one partial aggregate over all words, joined to the few
letter runs of the candidates; candidates are spread by a hash of their place, so a
hot document or value is no hot key.

Defined results: null and empty texts have no candidates; a word that occurs twice is
two findings; a null path has depth 0; labelled values that are null are ignored; with
labels of one kind only (or none) nothing can be learnt, so every candidate is kept with
score 1.0 but those reviewed as false, which score 0.0; an empty table gives no rows. Values leave the operator only as a hash and a mask.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, table

MIN_LENGTH = 12
CANDIDATE = rf"(?:(?=[^0-9]*[0-9]).{{{MIN_LENGTH},}}|[^A-Z]*[A-Z]{{16,}}.*)"
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|credential|auth|bearer|private.?key)"
SAMPLE_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|mocks?|fixtures?|docs?|demo)([/_.-]|$)"
#: Tokens with an issuer's prefix (bare, quoted or assigned), and values of 8 or more characters with a
#: digit that are assigned to a credential's name in the same word.
ISSUED = (r"(?:^|[\"'`=:])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeprs]-[\w-]{10,}"
          r"|[sr]k_live_[0-9A-Za-z]{16,}|AIza[\w-]{35}|sk-[\w-]{20,}|npm_[0-9A-Za-z]{36}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]+)(?![\w-])")
ASSIGNED = (r"^(?i)[\"']?[\w.-]*(?:password|passwd|passphrase|pwd|secret|token|api_?-?key|access_?-?key)[\"']?[:=]"
            r"(?=[^0-9]*[0-9])[\"'`]?[^\s\"'`<>${}()@/]{8,}[\"'`]?[,;]?$")
#: The smallest number of occurrences of a word of the dictionary.
DICTIONARY_COUNT = 5
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 40, 8, 17
THRESHOLD = 0.5
FEATURES = ["length", "digits", "capitals", "marks", "transitions", "coverage", "sample_path", "path_depth",
            "word_before", "word_after", "assigned", "credential_inside", "quoted", "neighbour_length"]


def _rest(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, position (of the word in the text), value, path, before2, before1, after of every candidate."""
    could = docs.filter(F.col(text).rlike("[0-9]|[A-Z]{16}"))
    words = could.select(F.col(key).alias("doc_id"), F.col(path).alias("path"),
                         F.regexp_extract_all(F.col(text), F.lit(WORD), 0).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike(f"^{CANDIDATE}$"))
    found = words.filter(F.size("w") > 0).select("doc_id", "path", "w", F.explode(at).alias("position"))
    def word(d):
        return F.coalesce(F.get("w", F.col("position") + d), F.lit(""))
    return found.select("doc_id", "path", "position", word(0).alias("value"), word(-2).alias("before2"),
                        word(-1).alias("before1"), word(1).alias("after"))


def dictionary(docs: DataFrame, text: str, wanted: DataFrame, least: int) -> DataFrame:
    """The wanted words (column run) that the corpus holds as whole lower-case words at least ``least`` times."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0)).alias("run"))
    counts = words.filter(F.col("run").rlike("^[a-z]{3,24}$")).groupBy("run").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least).join(wanted, "run", "left_semi").select("run")


def features(found: DataFrame, docs: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """Candidates with an id and their features."""
    v = F.col("value")
    runs = F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,24}"), 0)
    base = cut(found.withColumn("runs", runs).withColumn("finding", F.xxhash64("doc_id", "position", "value")), "secret-candidates")
    parts = base.select("value", F.explode("runs").alias("run")).distinct()
    known = dictionary(docs, text, parts.select("run").distinct(), least)
    covered = parts.join(known, "run").groupBy("value").agg(F.collect_set("run").alias("known"))
    covered = covered.withColumnRenamed("value", "_v")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        v, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    n = F.length(v).cast("double")
    near = F.concat_ws(" ", "before2", "before1")
    b = base.join(covered, base["value"] == covered["_v"], "left").drop("_v")
    letters = F.aggregate(F.filter("runs", lambda r: F.array_contains("known", r)), F.lit(0), lambda a, r: a + F.length(r))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return (b.withColumn("length", n).withColumn("digits", _rest(v, "[0-9]") / n).withColumn("capitals", _rest(v, "[A-Z]") / n)
            .withColumn("marks", _rest(v, "[^0-9A-Za-z]") / n)
            .withColumn("transitions", (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n)
            .withColumn("coverage", F.coalesce(letters, F.lit(0)) / n)
            .withColumn("sample_path", flag(F.col("path").rlike(SAMPLE_PATH)))
            .withColumn("path_depth", F.coalesce(F.size(F.split("path", "/")) - 1, F.lit(0)).cast("double"))
            .withColumn("word_before", flag(near.rlike(CREDENTIAL))).withColumn("word_after", flag(F.col("after").rlike(CREDENTIAL)))
            .withColumn("assigned", flag(F.col("before1").rlike("[:=]$") | v.rlike("^[A-Za-z_.-]+[:=]")))
            .withColumn("credential_inside", flag(v.rlike(CREDENTIAL)))
            .withColumn("quoted", flag(v.rlike("[\"'`]")))
            .withColumn("neighbour_length", (F.length("before2") + F.length("before1") + F.length("after")) / F.lit(3.0))
            .drop("runs", "known"))


def score(found: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``found`` (with features) -> + score. ``labelled``: rows of ``found`` with a column label (0 or 1)."""
    vec = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    rows = (labelled.filter("label IS NOT NULL").select("finding", F.col("label").cast("double").alias("label"), *FEATURES)
            .withColumn("_h", F.xxhash64("finding", "label")))
    each = [rows.filter(c).orderBy("_h", "finding", *FEATURES).limit(train_rows) for c in ("label = 0", "label <> 0")]
    sample = each[0].unionByName(each[1]).coalesce(1).sortWithinPartitions("_h", "finding", *FEATURES)
    sample = cut(sample, "secret-training")                   # a bounded sample, in one order
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        reviewed = F.col("label") if "label" in found.columns else F.lit(None)
        return found.withColumn("score", F.when(reviewed == 0, 0.0).otherwise(1.0))
    model = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                   probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(vec.transform(sample))
    return model.transform(vec.transform(found)).withColumn(
        "score", F.round(vector_to_array("_p")[1], 9)).drop("_x", "_p", "_r", "_y")


def review(found: DataFrame) -> DataFrame:
    """Labels for findings of the issuer formats that a reviewer can decide on sight (null: not reviewed).

    Stands in for a table of reviewed findings: keys with an issuer's prefix, assigned
    passwords and quoted tokens are real; addresses, card-like numbers and host numbers are not.
    """
    v = F.col("value")
    real = v.rlike(ISSUED) | v.rlike(ASSIGNED) | (v.rlike("^[\"'`](?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z]{20,}[\"'`][,;]?$") & F.col("before1").rlike("[:=]$"))
    other = (v.rlike("@") | v.rlike("^[0-9]{13,19}$") | v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | v.rlike("^(?i)https?://")
             | v.rlike("^[A-Z]+[!.,]+$"))
    return found.withColumn("label", F.when(real, 1).when(other, 0))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", labels: DataFrame | None = None,
         train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every candidate with features, label (null: not reviewed), score and is_secret.

    ``labels`` (value, label) are reviewed findings; without them ``review`` labels the sample.
    """
    found = features(candidates(docs, key, text, path), docs, text)
    if labels is None:
        found = review(found)
    else:
        seen = labels.filter("value IS NOT NULL").groupBy(F.col("value").alias("_v")).agg(F.max("label").alias("label"))
        found = found.join(seen, found["value"] == seen["_v"], "left").drop("_v")
    found = cut(found, "secret-features")
    return score(found, found, train_rows).withColumn("is_secret", F.col("score") >= THRESHOLD)


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "position", F.sha2("value", 256).alias("value_sha256"),
                      F.concat(F.substring("value", 1, 3), F.lit("***")).alias("masked"), *FEATURES, "label", "score", "is_secret")
