"""Secret scan with a random forest that removes false positives (DataFrame functions only).

Candidates are private-key blocks, long runs of key characters with a digit, and shorter or digit-free runs behind a known
prefix or a secret's name and sign. For each one the forest sees its length,
its character transitions, how much of it dictionary words cover, the path, and the words before it. The forest is
trained from labelled findings with Spark's own learner; its trees are then turned into a SQL expression, so that
scanning is one projection over the texts: no shuffle, no join, no UDF. A text is cut at its candidates, and the piece before a
candidate is its neighbourhood; gluing the pieces together again around a mark redacts in linear time.

The default findings are made from templates by hash: 4,000 rows at most, a fixed number. A table of real findings with
the columns value, before, after, path and is_secret can be given instead; it is fitted on at most ``most_findings`` of its rows.

Edge cases: null and empty texts have no candidates; a null path counts as unknown; repeated rows are scanned alike; empty
tables give no rows; extra columns pass through ``redact`` unchanged and are ignored elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: What a candidate looks like: a key block, a long run with a digit, a known prefix, or what is assigned to a secret's name. A run
#: before "=" and more is a name and stays in the text before its value; "=" belongs to a value as trailing padding only. A key block
#: reaches to its END line, over its headers; without one it holds the header lines and lines of key characters that follow.
_NAMES = "token|secret|passw(?:or)?d|pwd|api.?key|access.?key|credentials?|private.?key"
_RUN = "A-Za-z0-9_+/.-"
VALUE = (
    "-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    "|(?:\\s*+(?:[A-Za-z-]{1,40}: [^\n]*+|[A-Za-z0-9+/=]{16,}+))*+(?:\\s*+[A-Za-z0-9+/]{1,15}+={1,2})?+)"
    f"|(?<![{_RUN}])(?=[{_RUN}]{{8}})(?:(?<==)|(?![{_RUN}]*+=[{_RUN}]))(?:"
    f"(?=[A-Za-z_+/.-]*+[0-9])[{_RUN}]{{15,}}[A-Za-z0-9_+/]"
    "|(?:AKIA|ASIA)[A-Z0-9]{12,}|(?:gh[pousr]_|glpat-|xox[abpr]-|AIza)[A-Za-z0-9_-]{12,}"
    f"|(?<=(?i:{_NAMES})[\"']?\\s{{0,3}}(?:=|:|:=|=>)\\s{{0,3}}[\"']?)[{_RUN}]{{7,}}[A-Za-z0-9_+/])"
    "(?:={1,2}(?![A-Za-z0-9_+/=.-]))?")
MARK = "[SECRET]"
#: Characters before and after a candidate that count as its neighbouring words.
BEFORE, AFTER = 48, 8
#: Fixed lists: words that name secrets or other long values, words that stand in for a value, dictionary words, bigrams of running text.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth|credential|private|bearer|signing"
OTHER_WORDS = "commit|sha|md5|checksum|digest|revision|uuid|guid|integrity|etag|hash|version|order|card|phone|account|invoice|isbn|id\\b|url|http|file|path|image|public"
PLACEHOLDERS = "example|sample|dummy|placeholder|change.?me|replace|your|insert|todo|xxxx|here|redacted|none|null|default|test"
DICTIONARY = tuple(
    "about above access account action active address after again all also and animal another answer any api apple array asset audio author "
    "back bar base battery before between bird block blue board body book bridge build button cache call cat change chart child city class clear client close cloud code "
    "coffee color config correct count country create data date day default delete device dog door down dream dummy earth east edit email empty error event "
    "example false field file fire fish flag flower foo form forest friend from function garden green group guest hand hello here home horse house image import "
    "index input insert internal island item key kitchen label lake language last letter level light line link list local login long love machine magic mail "
    "main master message method module monkey moon morning mother mountain music name night none note null number ocean office online open orange order page paper "
    "password path person phone picture placeholder planet profile project public purple rain release replace request river road root sample secret server service "
    "shadow silver simple sister small snow some song spring staple star static stone storage summer sun super system table test the thing this time token tree true "
    "user value version water white window winter with word world your".split())
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li"
KNOWN = "^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abpr]-|sk[-_]|eyJ|AIza|-----BEGIN)"
TEST_PATH = "(?i)test|example|sample|fixture|mock|docs?/|spec|vendor|node_modules"
FEATURES = (
    "length", "digits", "uppers", "lowers", "symbols", "hexes", "variety", "switches", "bigrams", "covered", "secret_word", "other_word",
    "near_secret", "assigned", "quoted", "known", "block", "placeholder", "test_path")


def features(value: Column, before: Column, after: Column, path: Column, dictionary: tuple[str, ...] = DICTIONARY) -> Column:
    """The forest's inputs as a struct of doubles. At each place the longest of the dictionary's words counts."""
    entries = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    n = F.greatest(F.char_length(value), F.lit(1))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    small, left = F.lower(value), F.lower(before)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    columns = {
        "length": n.cast("double"),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share("[^A-Za-z0-9]"), "hexes": share("[0-9a-fA-F]"),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        "switches": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "bigrams": F.regexp_count(small, F.lit(f"(?=(?:{BIGRAMS}))")) / n,
        "covered": (n - F.char_length(F.regexp_replace(small, entries, ""))) / n,
        "secret_word": flag(F.rlike(left, F.lit(SECRET_WORDS))), "other_word": flag(F.rlike(left, F.lit(OTHER_WORDS))),
        "near_secret": flag(F.rlike(left, F.lit(f"(?:{SECRET_WORDS})[a-z_-]*[\"' ]*(?:[:=]|is|:=|=>)?[\"' ]*$"))),
        "assigned": flag(F.rlike(before, F.lit("[=:]\\s*[\"']?$"))),
        "quoted": flag(F.rlike(before, F.lit("[\"'`]$")) & F.rlike(after, F.lit("^[\"'`]"))),
        "known": flag(F.rlike(value, F.lit(KNOWN))), "block": flag(F.startswith(value, F.lit("-----BEGIN"))),
        "placeholder": flag(F.rlike(small, F.lit(PLACEHOLDERS))),
        "test_path": flag(F.rlike(F.coalesce(path, F.lit("")), F.lit(TEST_PATH))),
    }
    return F.struct(*(c.cast("double").alias(k) for k, c in columns.items()))


def template_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled findings: value, before, after, path, is_secret."""
    i = F.col("id")
    text = lambda k: F.concat(i.cast("string"), F.lit(k))
    pick = lambda k, *options: F.element_at(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    hex40, hex32, hex64 = F.sha1(text("a")), F.md5(text("b").cast("binary")), F.sha2(text("c"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(text("d"), 256))), "[.]", "")
    digits = F.substring(F.regexp_replace(F.sha2(text("e"), 512), "[a-f]", ""), 1, 16)
    uuid = F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    # passphrases: three or four dictionary words, some with a number behind
    plain = [w for w in DICTIONARY if len(w) > 3 and not re.search(PLACEHOLDERS, w)]
    word = lambda k: F.element_at(F.array(*(F.lit(w) for w in plain)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(plain))) + 1).cast("int"))
    joint = pick("j", "", "", "-", "_")
    phrase = F.concat(F.concat_ws("|", word("p1"), word("p2"), word("p3")), pick("t", "", "", "7", "42"))
    phrase = F.regexp_replace(phrase, "[|]", joint)
    kind = pick("bk", "RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "PGP PRIVATE KEY BLOCK")
    headers = pick("bh", "", "", F.concat(F.lit("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,"), hex32, F.lit("\n\n")))
    body = F.array_join(F.array_repeat(F.concat(b64, hex32, F.lit("\n")), (F.pmod(F.xxhash64(i, F.lit("bl")), F.lit(20)) + 1).cast("int")), "")
    block = F.concat(F.lit("-----BEGIN "), kind, F.lit("-----\n"), headers, body, pick("be", "", F.concat(F.lit("-----END "), kind, F.lit("-----"))))
    # hosts, and single words behind a secret's name, as in "password: forgotten"
    host = F.concat(word("h1"), F.pmod(i, F.lit(90)).cast("string"), F.lit("."), word("h2"), pick("ht", ".com", ".org", ".net", ".example"))
    single = F.concat(word("s1"), pick("se", "s", "ing", "en", "able", ""))
    secret = pick("v", hex40, hex32, hex64, b64, F.substring(b64, 1, 20), F.upper(hex40), F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", "x"), 1, 16))),
                  F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", "y"), 1, 36)), F.concat(F.lit("sk-"), hex40), F.concat(F.substring(b64, 1, 12), hex32), block, block, phrase, phrase)
    words = pick("w", "your-api-key-here-", "example_token_", "some_function_name_v", "assets/static/image_", "placeholder-value-", "release-notes-version-", "change-me-", "insert_password_here_", "test-default-config-", "theandtionered")
    harmless = pick("h", hex40, hex64, hex32, uuid, digits, F.concat(words, F.pmod(i, F.lit(9000)).cast("string"), F.lit("00")), F.concat(words, F.lit("2024"), F.lit("01")), F.concat(F.lit("2024-01-"), digits), F.repeat(F.lit("x1"), 12), host, host, F.concat(word("q1"), F.lit("/"), word("q2"), F.lit("/"), word("q3"), F.lit(".html")))
    named = pick("n", "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "credentials", "private_key", "TOKEN", "Bearer")
    other = pick("o", "commit", "sha256", "md5 checksum", "uuid", "order id", "card", "revision", "integrity", "file", "see the page", "phone", "account", "url", "and the word of", "", "", "")
    sign = pick("s", " = \"", ": \"", "=", ": ", " ", "='", " is ", " := \"")
    lead = pick("l", "the thing was ", "of for and ", "", "in this ", "config.", "export ", "und der ", "que la ")
    true = F.pmod(F.xxhash64(i, F.lit("y")), F.lit(2)) == 0
    # placeholders and numbers stay harmless behind the name of a secret
    weak = F.pmod(F.xxhash64(i, F.lit("q")), F.lit(2)) == 0
    value = F.when(true, secret).when(weak, pick("k", F.concat(words, F.lit("1234")), digits, F.repeat(F.lit("x1"), 12), F.concat(words, F.lit("00"), F.lit("01")), single, single)).otherwise(harmless)
    # what its prefix gives away stands half of the time without a name
    alone = F.rlike(value, F.lit(KNOWN)) & (F.pmod(F.xxhash64(i, F.lit("z")), F.lit(2)) == 0)
    before = F.when(alone, F.concat(lead, pick("u", "", "id ", "\n", "a "))).otherwise(F.concat(lead, F.when(true | weak, named).otherwise(other), sign))
    quote = F.when(F.rlike(sign, F.lit("[\"']$")), F.lit("\" ")).otherwise(F.lit(" and "))
    return spark.range(rows).select(value.alias("value"), before.alias("before"), quote.alias("after"), pick("p", "src/app.py", "src3", "lib/a/b.js", "tests/test_x.py", "docs/readme.md", "src0").alias("path"), true.cast("double").alias("is_secret"))


class Forest:
    """Trees as nested (feature, threshold, left, right) or a leaf's probability of "secret"."""

    def __init__(self, trees: list):
        self.trees = trees

    def probability(self, x: Column) -> Column:
        def walk(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(x[FEATURES[t[0]]] <= F.lit(t[1]), walk(t[2])).otherwise(walk(t[3]))

        return sum((walk(t) for t in self.trees[1:]), walk(self.trees[0])) / F.lit(float(len(self.trees)))


def train(findings: DataFrame, trees: int = 20, depth: int = 6, most_findings: int = 20_000, seed: int = 11) -> Forest:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    x = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path"))
    # bounded; one ordered partition, so that the same findings give the same forest
    rows = staged(findings.where(F.col("value").isNotNull() & F.col("is_secret").isNotNull()).select("value", "before", "after", "path", "is_secret").limit(most_findings), "findings")
    rows = rows.repartition(1).sortWithinPartitions("value", "before", "after", "path")
    rows = rows.select(x.alias("x"), F.col("is_secret").cast("double").alias("label")).select("x.*", "label")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            stats = list(n.impurityStats().stats())
            return stats[1] / max(sum(stats), 1e-12) if len(stats) > 1 else float(n.prediction())
        split = n.split()
        return (int(split.featureIndex()), float(split.threshold()), node(n.leftChild()), node(n.rightChild()))

    return Forest([node(t._java_obj.rootNode()) if hasattr(t, "_java_obj") else node(t._java_model.rootNode()) for t in model.trees])


_TRAINED: dict[str, Forest] = {}


def default_forest(spark: SparkSession) -> Forest:
    """The forest of the template findings, fitted once in a driver process."""
    if "" not in _TRAINED:
        _TRAINED[""] = train(template_findings(spark))
    return _TRAINED[""]


def scan(docs: DataFrame, forest: Forest | None = None, path: str | None = "source") -> DataFrame:
    """``docs`` with _pieces (texts between candidates) and _found, the candidates (v) with their probabilities (p).

    Only texts that hold a candidate are cut up.
    """
    forest = forest or default_forest(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.rlike(text, F.lit(VALUE))
    d = docs.withColumn("_values", F.when(some, F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_pieces", F.when(F.size("_values") > 0, F.split(text, VALUE, -1)))
    where = F.col(path) if path and path in docs.columns else F.lit(None).cast("string")
    # arrays are zipped, not indexed inside a lambda, where an inlined array would be made again for every element
    n = F.size("_values")
    cut = F.arrays_zip(F.col("_values").alias("v"), F.slice("_pieces", F.lit(1), n).alias("b"), F.slice("_pieces", F.lit(2), n).alias("a"))
    cut = F.when(n > 0, cut).otherwise(F.array().cast("array<struct<v:string,b:string,a:string>>"))
    d = d.withColumn("_x", F.transform(cut, lambda c: F.struct(c["v"].alias("v"), features(c["v"], F.right(c["b"], F.lit(BEFORE)), F.left(c["a"], F.lit(AFTER)), where).alias("x"))))
    return d.withColumn("_found", F.transform("_x", lambda c: F.struct(c["v"].alias("v"), forest.probability(c["x"]).alias("p")))).drop("_x", "_values")


def redact(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by MARK, and n_chars, where there is one, counted anew."""
    names = docs.columns
    d = scan(docs, forest, path)
    said = F.transform("_found", lambda c: F.when(c["p"] >= threshold, F.lit(MARK)).otherwise(c["v"]))
    glued = F.array_join(F.zip_with("_pieces", said, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    hit = F.exists("_found", lambda c: c["p"] >= threshold)
    d = d.withColumn("_hit", hit).withColumn("text", F.when(F.col("_hit"), glued).otherwise(F.col("text")))
    if "n_chars" in names:
        d = d.withColumn("n_chars", F.when(F.col("_hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*names)


def op10(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, candidates, secrets, the highest probability, and the secrets' digests (never their values)."""
    d = scan(docs.select("doc_id", "text", "source"))
    hits = F.filter("_found", lambda c: c["p"] >= threshold)
    return d.withColumn("_hits", hits).select(
        "doc_id", F.size("_found").cast("long").alias("n_candidates"), F.size("_hits").cast("long").alias("n_secrets"),
        F.round(F.array_max(F.transform("_found", lambda c: c["p"])), 6).alias("max_probability"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda c: F.sha2(c["v"], 256)))), ",").alias("secrets_sha256"))
