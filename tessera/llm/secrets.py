"""Secret scanning with a random forest that removes false positives, in DataFrame functions and Spark's JVM forest only.

A candidate is a value of at least ``SHORT`` characters that is assigned (after ``=`` or ``:``) or quoted, whole, whatever characters it
has; or else a run of at least ``LEAST`` characters that keys are written in, or a web token with its dots. None needs a digit. Its features are
its length, how often and between which kinds its characters change (letters, digits, capitals, vowels), how much of it
dictionary words cover, what its path says, and which words stand before it. The forest is trained on labelled findings and
keeps the candidates it gives at least ``threshold``.

Scanning is one pass: documents that a single pattern rules out are not split, and the words of the others are read one
after the other in generated code, without a shuffle. No labelled findings come with the corpus; ``findings`` makes them by
rule (keys, tokens, web tokens and passwords; and prose, identifiers, digests, numbers, placeholders, addresses and names that look like
them), and any table with the same columns takes its place.

Defined results: a null or empty text has no candidate, and an empty table gives no rows; a null path is an empty one; rows that repeat give repeated findings, each with
its doc_id; equal scores are equal findings' (the threshold is inclusive); a word of any length is searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, SHORT = 16, 8
_RUN = rf"eyJ[A-Za-z0-9_\-]{{8,}}(?:\.[A-Za-z0-9_\-]{{8,}}){{1,2}}|[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}"
_QUOTE = "[\"'`]"
#: What a value may be, between its opening mark and the quote or punctuation that ends the word.
_VALUE = rf"([^\"'`\s=:/][^\"'`\s]{{{SHORT - 1},}}?){_QUOTE}?[,;.)\]}}]*$"
_ASSIGNED = rf"(?:[=:]{_QUOTE}?|^{_QUOTE}){_VALUE}"
#: Words that names and placeholders are made of.
DICTIONARY = "account address admin alpha archive backup base beta build cache change client cloud config connect content copy data default demo dev document download draft dummy edit email end example fake false file final foo bar form group guide header home host image index info input insert item key lang lib library list local log login main manager menu message model module name net new node note notes null object old order output package page password path photo placeholder post private prod product profile project public query read release report request response root sample script search secret server service session set site sort source staging start state static status store string style summary system table tag temp template test text theme thumb time title token true type update upload user value version video view web word work your".split()
_SECRET_WORDS = r"(?i)\b(token|secret|api|key|api_?key|\w*_(key|token|secret)|passw(or)?d|pwd|auth|bearer|credentials?|access|private)\b"
_DIGEST_WORDS = r"(?i)\b(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|id|isbn|card|phone|account|order|invoice)\b"
_FAKE_WORDS = r"(?i)\b(example|sample|dummy|fake|placeholder|test|demo|your)\b"
FEATURES = ["length", "changes", "digits", "capitals", "symbols", "vowel_pairs", "repeats", "hexadecimal", "dashes", "covered", "known_form", "test_path", "code_path", "assigned", "quoted", "secret_word", "digest_word", "fake_word"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", before: int = 3) -> DataFrame:
    """doc_id, path, at (number of the word), candidate, lead (what stands before it), for every candidate."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    any_ = rf"[A-Za-z0-9+/_\-]{{{LEAST}}}|eyJ[A-Za-z0-9_\-]{{8,}}\.|[=:]\s*{_QUOTE}?[^\s\"'`]{{{SHORT}}}|{_QUOTE}[^\s\"'`]{{{SHORT}}}"
    words = rows.filter(F.col("text").rlike(any_)).select("doc_id", "path", F.split("text", r"\s+").alias("words"))
    each = words.select("doc_id", "path", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at")).withColumn("word", F.element_at("words", F.col("at") + 1))
    hit = each.filter(F.length("word") >= SHORT)
    lead = F.array_join(F.slice("words", F.greatest(F.col("at") + 1 - before, F.lit(1)), F.least(F.col("at"), F.lit(before))), " ")
    hit = hit.select("doc_id", "path", "at", "word", lead.alias("lead"))
    # The whole word after an assignment, else what is assigned or quoted in it, else the runs.
    after = F.when(F.col("lead").rlike(r"[=:]$"), F.regexp_extract("word", rf"^{_QUOTE}?{_VALUE}", 1)).otherwise("")
    inside = F.when(F.col("word").rlike("[=:\"'`]"), F.regexp_extract("word", _ASSIGNED, 1)).otherwise("")
    value = F.when(after != "", after).otherwise(inside)
    runs = F.when(F.length("word") >= LEAST, F.regexp_extract_all("word", F.lit(f"({_RUN})"), 1)).otherwise(F.array().cast("array<string>"))
    found = hit.withColumn("value", value).select("doc_id", "path", "at", "word", "lead", F.explode(F.when(F.col("value") != "", F.array("value")).otherwise(runs)).alias("candidate"))
    return found.withColumn("lead", F.concat_ws(" ", "lead", F.call_function("substring_index", F.col("word"), F.col("candidate"), F.lit(1)))).select("doc_id", "path", "at", "candidate", "lead")


def features(found: DataFrame) -> DataFrame:
    """``found`` (candidate, lead, path) with a column for each of FEATURES."""
    c, n = F.col("candidate"), F.length("candidate")
    per = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    runs = F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), 1), lambda w: F.when(w.isin(DICTIONARY), F.length(w)).otherwise(0))
    made: dict[str, Column] = {
        "length": n, "changes": per("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"), "digits": per("[0-9]"), "capitals": per("[A-Z]"),
        "vowel_pairs": per("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"), "repeats": per(r"(.)(?=\1)"), "symbols": per(r"[^A-Za-z0-9_/+.\-]"), "hexadecimal": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "dashes": per("[-_/]"),
        "covered": F.aggregate(runs, F.lit(0), lambda s, x: s + x) / n, "known_form": c.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-.{10,}|sk_(live|test)_.{16,}|eyJ[A-Za-z0-9_-]{8,}([.][A-Za-z0-9_-]{8,})+)$"),
        "test_path": F.col("path").rlike("(?i)test|example|fixture|sample|doc|mock"), "code_path": F.col("path").rlike(r"(?i)\.(py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|conf|sh)$"),
        "assigned": F.col("lead").rlike(r"[=:]\s*[\"'`]?$"), "quoted": F.col("lead").rlike("[\"'`]$"), "secret_word": F.col("lead").rlike(_SECRET_WORDS), "digest_word": F.col("lead").rlike(_DIGEST_WORDS), "fake_word": F.col("lead").rlike(_FAKE_WORDS),
    }
    return found.select("*", *[made[k].cast("double").alias(k) for k in FEATURES])


def findings(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """n labelled findings (path, candidate, lead, label) by rule; the same rows each time."""
    row = F.col("id")
    draw = lambda seed, most: F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(most)).cast("int")
    pick = lambda seed, *values: F.element_at(F.array(*[F.lit(v) for v in values]), draw(seed, len(values)) + 1)
    noise = lambda seed: F.concat(*[F.sha2(F.concat_ws(":", row, F.lit(seed + k)), 512) for k in range(2)])

    def text(seed: int, letters: str, low: int, high: int) -> Column:
        size = F.lit(low) + draw(seed + 1, high - low + 1)
        chars = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.substring(F.lit(letters), F.pmod(F.xxhash64(row, k, F.lit(seed)), F.lit(len(letters))).cast("int") + 1, F.lit(1)))
        return F.array_join(chars, "")

    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda seed: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), draw(seed, len(DICTIONARY)) + 1)
    hexes = lambda seed, size: F.substring(noise(seed), 1, size)

    def prose(seed: int, low: int, high: int) -> Column:
        """A word of syllables."""
        sound = lambda k: F.concat(*[F.substring(F.lit(letters), F.pmod(F.xxhash64(row, k, F.lit(seed + n)), F.lit(len(letters))).cast("int") + 1, F.lit(1)) for n, letters in enumerate(("bcdfghlmnprstvwz", "aeiouaeiy", "nrstlnrdhc"))])
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(low) + draw(seed + 5, high - low + 1)), sound), "")

    names = ("token", "api_key", "secret", "password", "access token", "auth", "client secret", "key", "API key", "bearer", "db_password", "PASSWORD", "passwd")
    said = F.when(draw(19, 2) == 0, prose(60, 1, 2)).otherwise(pick(20, "the", "and", "of", "de"))
    sign = pick(22, " = \"", "=", ": ", " = '", ":\"", " = ")
    assigned = F.concat(said, F.lit(" "), pick(21, *names), sign)
    other_name = F.concat(said, F.lit(" "), F.when(draw(18, 2) == 0, word(56)).otherwise(prose(70, 1, 3)), sign)
    plain = F.concat(F.when(draw(17, 3) == 0, word(23)).otherwise(prose(80, 1, 3)), F.lit(" "), prose(90, 1, 3), pick(25, " ", " (", " ", ". "))
    symbol = lambda seed: pick(seed, "!", "$", "#", "@", "%", "&", "*", "?")
    kinds = [
        (1, hexes(100, 40), assigned), (1, hexes(200, 32), assigned), (1, text(300, every, 20, 64), assigned), (1, F.concat(F.lit("AKIA"), text(400, every[:26] + every[52:], 16, 16)), plain),
        (1, F.concat(F.lit("ghp_"), text(500, every, 36, 36)), plain), (1, F.concat(F.lit("sk_live_"), text(600, every, 24, 32)), assigned), (1, text(700, every + "+/", 40, 44), assigned),
        (1, F.concat(F.lit("eyJ"), text(710, every, 16, 40), F.lit("."), text(720, every, 20, 60), F.lit("."), text(730, every + "_-", 30, 43)), F.when(draw(16, 2) == 0, assigned).otherwise(plain)),
        (1, F.concat(text(740, every, 5, 9), symbol(741), text(742, every, 3, 7)), assigned), (1, text(750, every[:52], 20, 32), assigned), (1, F.concat(word(751), text(752, every[52:], 2, 4), symbol(753)), assigned),
        (1, text(760, every, 8, 14), assigned), (1, F.upper(hexes(770, 40)), assigned),
        (0, F.concat_ws("-", hexes(800, 8), hexes(810, 4), hexes(820, 4), hexes(830, 4), hexes(840, 12)), F.concat(pick(26, "id", "uuid", "request id", "session"), pick(27, "=", ": ", " "))),
        (0, hexes(900, 40), F.concat(pick(28, "commit", "sha1", "revision", "see commit", "etag"), pick(29, " ", ": ", "="))), (0, hexes(1000, 64), F.concat(pick(30, "sha256", "checksum", "digest", "integrity"), pick(31, ":", " ", "="))),
        (0, text(1100, every[52:], 16, 19), plain), (0, F.concat_ws("-", word(35), word(36), word(37), text(1200, every[52:], 1, 4)), plain),
        (0, F.concat_ws("_", word(38), word(39), word(40), text(1300, every[52:], 1, 4)), assigned), (0, F.concat(F.repeat(pick(41, "x", "X", "0", "a1", "abc1", "*"), 20), F.lit("1")), assigned),
        (0, F.concat_ws("/", F.lit(""), word(42), word(43), word(44), text(1400, every[52:], 1, 6)), plain), (0, F.concat(F.lit("your"), pick(57, "_", "-", ""), word(45), word(46), F.lit("key"), word(47)), assigned),
        (0, text(1500, every[26:], 18, 40), plain), (0, hexes(1600, 40), F.concat(pick(48, "example", "dummy", "sample", "fake"), pick(49, " token = \"", " key: ", " secret=\""))),
        (0, prose(1700, 5, 12), plain), (0, F.initcap(prose(1710, 5, 12)), plain), (0, F.upper(prose(1720, 5, 9)), plain), (0, F.concat_ws("-", prose(1730, 2, 4), prose(1740, 2, 4), prose(1750, 1, 3)), plain),
        (0, prose(1760, 3, 7), other_name), (0, F.concat(prose(1770, 3, 5), pick(58, ".", ",", ")")), other_name), (0, F.concat(prose(1780, 2, 3), F.lit("."), text(1790, every[52:], 1, 3), F.lit("@mail.example.com")), other_name),
        (0, F.concat(text(1800, "12", 1, 1), text(1810, every[52:], 3, 3), F.lit("-0"), text(1820, "123456789", 1, 1), F.lit("-1"), text(1830, every[52:], 1, 1)), other_name), (0, F.concat(F.lit("${"), F.upper(word(1840)), F.lit("_"), F.upper(word(1841)), F.lit("}")), assigned),
        (0, F.concat(F.lit("os.environ["), F.upper(word(1850)), F.lit("]")), assigned), (0, F.concat(F.lit("<"), word(1860), F.lit("-"), word(1861), F.lit(">")), assigned), (0, prose(1870, 3, 5), F.concat(prose(1880, 1, 2), pick(59, " \"", " '", " `"))),
    ]
    kind = F.pmod(row, F.lit(len(kinds)))
    choose = lambda k: F.coalesce(*[F.when(kind == i, kinds[i][k] if k else F.lit(kinds[i][0])) for i in range(len(kinds))])
    path = pick(50, "src0", "src1", "web", "src/app.py", "config/prod.yaml", "docs/readme.md", "tests/test_app.py", "")
    return spark.range(0, n, 1, 4).select("id", path.alias("path"), choose(1).alias("candidate"), choose(2).alias("lead"), choose(0).alias("label"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7):
    """A fitted forest over FEATURES."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(labelled)).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)


def scan(docs: DataFrame, model, threshold: float = 0.5, **columns) -> DataFrame:
    """doc_id, path, at, candidate and score of the candidates that the forest keeps."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, **columns)))
    scored = model.transform(rows).select("doc_id", "path", "at", "candidate", F.element_at(vector_to_array("probability"), 2).alias("score"))
    return scored.filter(F.col("score") >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs, train(findings(spark)))
    return found.select("doc_id", "at", F.length("candidate").alias("n_chars"), F.md5("candidate").alias("secret_md5"), F.round("score", 6).alias("score"))
