"""Secret scans with DataFrame functions only.

Candidates are runs of token characters found by patterns; a random forest, trained from labelled findings, tells
secrets from false positives by a candidate's length, character transitions, dictionary coverage, path and neighbouring
words. Confirmed spans are redacted.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that tell what is assigned to them.
TELLING = r"(?:api[_\- ]?key|access[_\- ]?key|secret|token|passw(?:or)?d|passphrase|pwd|credentials?|auth|bearer|private[_\- ]?key|client[_\- ]?secret|pass)"
ASSIGN = r"[\"'`]?\s{0,2}(?:=>|:=|[=:])\s{0,2}"
#: Runs that may be secrets. A private key block; the password or token before the host of a URL; 6 or more printable ASCII
#: characters, quoted or not, that are assigned to a telling word; 16 or more token characters with a digit and a letter.
CANDIDATE = "|".join(
    (
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s]++|-(?!----))++-----END [A-Z ]{0,30}PRIVATE KEY-----",
        r"(?<=:)(?<=://[A-Za-z0-9_.~%+\-]{0,64}:)[!-~&&[^/@:\"'`<>]]{4,}+(?=@)",
        r"(?<=/)(?<=://)[!-~&&[^/@:\"'`<>]]{16,}+(?=@)",
        rf"(?<=[=:>]\s{{0,2}}[\"'`])(?<=(?i:{TELLING}){ASSIGN}[\"'`])[!-~&&[^\"'`]]{{6,}}+(?=[\"'`])",
        rf"(?<=[=:>]\s{{0,2}})(?<=(?i:{TELLING}){ASSIGN})[!-~&&[^\"'`<>(),;{{}}\[\]]]{{6,}}+",
        r"(?<![A-Za-z0-9_\-./+@])(?=[A-Za-z_\-./+]*+[0-9])(?=[0-9_\-./+]*+[A-Za-z])[A-Za-z0-9_\-./+]{16,}+={0,2}(?![A-Za-z0-9_@])",
    )
)
#: What a text with a candidate holds: only such texts are searched.
GATE = r"[=:>]\s{0,2}[\"'`]?[!-~]{4}|[A-Za-z0-9_\-./+]{16}|-----BEGIN"
#: Words next to a candidate that speak for a secret, and words and shapes that speak against it.
NAMES = rf"(?i){TELLING}"
HARMLESS = r"(?i)(sha\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|hash|example|sample|dummy|placeholder|build|version|image|file|path|id)\W*$"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|sk_live_|rk_live_|sk-|xox[abprs]-|glpat-|AIza|ya29\.|eyJ|npm_|pypi-|SG\.|-----BEGIN)"
#: Common letter pairs: their share is the candidate's dictionary coverage (words are mostly made of them).
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
#: Common words of names and prose: the share of a candidate that they cover is its coverage by whole words.
WORDS = (
    "about after again because before between change config could data default description during error every example false file first found from"
    " function group have house index information input into item level like list local main make master message method module more most name never"
    " number object only option order other output page part password people place point postgres process request required response result right"
    " root sample secret section server service some state string system table test text than that their them then there these they thing this time"
    " token true type under user username value version well were what when where which while will with word work world would year your"
).split()
FEATURES = (
    "length", "digits", "uppers", "classes", "transitions", "distinct", "hex", "pairs", "words", "longest_word", "slashes", "dots", "dashes", "symbols", "uuid", "prefix", "named", "assigned", "quoted", "userinfo", "called",
    "harmless", "placeholder", "path_test", "path_config",
)


def _candidates(text: Column) -> tuple[Column, Column]:
    """(candidates of a text in order, the text between them): a text is pieces[0], found[0], pieces[1], ..."""
    gate = text.rlike(GATE)
    found = F.when(gate, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return found, F.when(gate, F.split(text, CANDIDATE, -1)).otherwise(F.array(text))


def _judged(found: Column, pieces: Column, score) -> Column:
    """For each candidate the piece before it, its value and its score by value and neighbouring characters, of which those
    of the candidates beside it are some."""

    def near(array: Column, i: Column) -> Column:
        return F.coalesce(F.get(array, i), F.lit(""))

    def one(value: Column, i: Column) -> Column:
        before = F.concat(F.right(near(found, i - 1), F.lit(40)), near(pieces, i))
        after = F.concat(F.substring(near(pieces, i + 1), 1, 20), F.substring(near(found, i + 1), 1, 20))
        return F.struct(near(pieces, i).alias("piece"), value.alias("value"), score(value, F.right(before, F.lit(40)), F.substring(after, 1, 20)).alias("score"))

    return F.transform(found, one)


def _features(value: Column, before: Column, after: Column, path: Column | None = None) -> list[Column]:
    """FEATURES of a candidate, its neighbours and the path of its text, as doubles."""
    path = F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))
    size = F.greatest(F.length(value), F.lit(1))

    def share(pattern: str) -> Column:
        return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / size

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    made = {
        "length": F.least(F.length(value), F.lit(200)),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "classes": sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0)),
        "transitions": (F.length(kinds) - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hex": value.rlike("^(0x)?[0-9a-fA-F]+$"),
        "pairs": (F.length(value) - F.length(F.regexp_replace(F.lower(value), "|".join(PAIRS), ""))) / size,
        "words": (F.length(value) - F.length(F.regexp_replace(F.lower(value), "|".join(WORDS), ""))) / size,
        "longest_word": F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda w: F.length(w))) / size,
        "slashes": share("/"),
        "dots": share(r"\."),
        "dashes": share("[-_]"),
        "symbols": share("[^A-Za-z0-9_./+=-]"),
        "uuid": value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
        "prefix": value.rlike(PREFIX),
        "named": before.rlike(NAMES + r"\W{0,12}$"),
        "assigned": before.rlike(r"(=|:|=>)\s*[\"'`]?$"),
        "userinfo": before.rlike(r"://[^\s/@]*$") & after.startswith("@"),
        "quoted": before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        "called": after.rlike(r"^[(\[]"),
        "harmless": before.rlike(HARMLESS),
        "placeholder": value.rlike(r"(?i)(example|sample|dummy|placeholder|change|your|xxxx|test|foo|0000|1234567|\*{4}|^\$|environ|process\.env|os\.get|^%)"),
        "path_test": path.rlike(r"(?i)(^|[/_.\-])(tests?|spec|fixtures?|examples?|samples?|docs?|mocks?)([/_.\-]|$)"),
        "path_config": path.rlike(r"(?i)(\.env|\.ya?ml|\.json|\.toml|\.ini|\.properties|\.conf|config|settings|credentials)"),
    }
    return [F.coalesce(made[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES]


def labelled_findings(spark: SparkSession, n: int = 300) -> DataFrame:
    """(value, before, after, path, label): findings labelled by how they are made, ``n`` of each kind below.

    Secrets: hexadecimal, base64 and prefixed keys, short and symbol-rich passwords and passphrases that are assigned to
    telling names, passwords and tokens in URLs, private keys. Others: digests, UUIDs, paths, host names, dates with times,
    numbers with units, placeholders, long words with digits in running text, and words, calls and references to
    variables after a telling name. A seventh of all findings has the path of a configuration, a seventh that of a test."""
    raw = spark.range(n).selectExpr("id", "sha1(CAST(id AS string)) AS h", "sha2(CAST(id AS string), 256) AS s", "base64(unhex(sha2(concat('b', id), 256))) AS b", "upper(md5(CAST(id AS string))) AS m")
    name = "element_at(array('token', 'api_key', 'secret', 'password', 'access_key', 'auth_token', 'client_secret', 'apiKey', 'credential'), CAST(id % 9 + 1 AS int))"
    sign = "element_at(array(' = \"', '=\"', ': \"', '=', ': ', ' = ', '\": \"'), CAST(id % 7 + 1 AS int))"
    close = "IF(id % 7 IN (0, 1, 2, 6), '\"', ' ')"
    word = "element_at(array('the', 'of', 'ing', 'with', 'and', 'for', 'der', 'que', 'les', 'a'), CAST(id % 10 + 1 AS int))"
    pw = "element_at(array('password', 'passwd', 'pwd', 'secret', 'DB_PASSWORD', 'pass', 'passphrase'), CAST(id % 7 + 1 AS int))"
    plain = "element_at(array('apple', 'river', 'stone', 'candle', 'orange', 'winter', 'garden', 'silver', 'monkey', 'rocket', 'purple'), CAST({} % 11 + 1 AS int))"
    p1, p2, p3 = plain.format("id"), plain.format("(id * 7 + 3)"), plain.format("(id * 5 + 1)")
    mark = "element_at(array('!', '&', '#', '$', '%', '^', '*', '?', '+'), CAST({} % 9 + 1 AS int))"
    quote = "element_at(array(' = \"', '=\"', ': \"', '\": \"'), CAST(id % 4 + 1 AS int))"
    host = "concat('@', element_at(array('db', 'github.com', 'cache.local:6379', 'example.org'), CAST(id % 4 + 1 AS int)), '/main')"
    scheme = "element_at(array('postgres', 'https', 'redis', 'mongodb+srv', 'amqp'), CAST(id % 5 + 1 AS int))"
    common = "element_at(array('required', 'string', 'something', 'optional', 'invalid', 'missing', 'expired', 'nothing', 'between', 'question', 'important', 'resets'), CAST(id % 12 + 1 AS int))"
    kinds = [
        (f"concat({p1}, {p2}, {p3})", f"concat({pw}, {quote})", "'\"'", 1),
        (f"concat(initcap({p1}), {mark.format('id')}, id * 37 % 1000, {mark.format("(id * 5 + 2)")})", f"concat({pw}, {sign})", close, 1),
        (f"concat(substring(b, 1, 4), {mark.format('id')}, substring(b, 5, CAST(3 + id % 8 AS int)), {mark.format("(id + 4)")})", f"concat({word}, ' ', {pw}, {sign})", close, 1),
        ("substring(translate(b, '+/=', 'Qx7'), 1, CAST(8 + id % 8 AS int))", f"concat({name}, {sign})", close, 1),
        ("translate(substring(b, 1, 32), '+/=0123456789', 'abcQWERTYUIOP')", f"concat({name}, {quote})", "'\"'", 1),
        ("substring(translate(b, '+/=', 'Qx7'), 1, CAST(8 + id % 20 AS int))", f"concat({scheme}, '://', {word}, 'user:')", host, 1),
        (f"concat({p1}, id * 37 % 1000, {p2})", f"concat({word}, ' ', {scheme}, '://app:')", host, 1),
        ("concat('ghp_', substring(translate(b, '+/=', 'XYZ'), 1, 36))", f"concat({scheme}, '://')", host, 1),
        ("concat('-----BEGIN PRIVATE KEY-----\\n', b, '\\n', s, '\\n-----END PRIVATE KEY-----')", f"concat({word}, ' ')", "' '", 1),
        (common, f"concat({word}, ' ', {pw}, element_at(array(': ', ' : ', '=', ' = '), CAST(id % 4 + 1 AS int)))", f"concat(' ', {word})", 0),
        (f"concat({common}, element_at(array('.', '', '-', '_'), CAST(id % 4 + 1 AS int)), {word})", f"concat({word}, ' ', {name}, ': ')", f"concat(' ', {word})", 0),
        (f"concat(element_at(array('os.environ', 'process.env.', '$', 'config.', 'settings.', 'self.', '%'), CAST(id % 7 + 1 AS int)), {pw})", f"concat({name}, {sign})", close, 0),
        (f"concat(element_at(array('get_', 'load.', 'read_', 'vault.fetch_', 'input'), CAST(id % 5 + 1 AS int)), {pw})", f"concat({name}, element_at(array('=', ' = ', ': '), CAST(id % 3 + 1 AS int)))", "element_at(array('()', '(name)', '[0]'), CAST(id % 3 + 1 AS int))", 0),
        ("concat(element_at(array('****', 'xxxx', 'changeme', 'password', 'your-'), CAST(id % 5 + 1 AS int)), element_at(array('****', 'xxxx', 'secret'), CAST(id % 3 + 1 AS int)))", f"concat({pw}, {sign})", close, 0),
        ("element_at(array('password', 'postgres', 'username', 'secret', 'example', 'changeme', 'root', 'localuser'), CAST(id % 8 + 1 AS int))", f"concat({scheme}, '://', {word}, 'user:')", host, 0),
        ("h", f"concat('lorem ', {word}, ' ', {name}, {sign})", f"{close}", 1),
        ("upper(h)", f"concat(upper({name}), upper({sign}))", f"{close}", 1),
        ("substring(s, 1, CAST(24 + id % 40 AS int))", f"concat({name}, {sign})", f"{close}", 1),
        ("b", f"concat({name}, {sign})", f"{close}", 1),
        ("translate(b, '+/=', 'abc')", f"concat('x ', {name}, {sign})", f"{close}", 1),
        ("concat('AKIA', substring(m, 1, 16))", f"concat({word}, ' ')", "' '", 1),
        ("concat(element_at(array('ghp_', 'sk_live_', 'glpat-', 'npm_'), CAST(id % 4 + 1 AS int)), substring(translate(b, '+/=', 'XYZ'), 1, 36))", f"concat({word}, ' ')", "' '", 1),
        ("h", f"concat('{{', {word}, ' commit ')", "' '", 0),
        ("h", f"concat({word}, ' sha1: ')", "' '", 0),
        ("s", f"concat({word}, ' checksum = ')", "' '", 0),
        ("lower(m)", f"concat({word}, ' md5=')", "' '", 0),
        ("h", f"concat({word}, ' ', {word}, ' ')", "' the '", 0),
        ("substring(s, 1, CAST(16 + id % 30 AS int))", f"concat({word}, ' ')", f"concat(' ', {word})", 0),
        ("concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-', substring(h, 13, 4), '-', substring(h, 17, 4), '-', substring(h, 21, 12))", f"concat({word}, ' uuid: ')", "' '", 0),
        ("concat('/usr/share/', id, '/lib/module', id % 7, '/index.html')", f"concat({word}, ' ')", "' '", 0),
        ("concat('www.site', id, '.example.com/page/', id)", f"concat({word}, ' ')", "' '", 0),
        ("concat('your-', {n}, '-here-', id)".replace("{n}", "element_at(array('token', 'secret', 'key'), CAST(id % 3 + 1 AS int))"), f"concat({name}, {sign})", f"{close}", 0),
        ("concat('example_placeholder_', id)", f"concat({name}, {sign})", f"{close}", 0),
        ("concat('2024-0', id % 9 + 1, '-11T', id % 24, '-30-00')", f"concat({word}, ' ')", "' '", 0),
        ("concat('theotherthing', id, 'andmore')", f"concat({word}, ' ')", f"concat(' ', {word})", 0),
    ]
    path = "element_at(array('', 'src/app.py', '', 'config/settings.yml', '', 'tests/fixtures/data.txt', ''), CAST(id % 7 + 1 AS int))"
    made = ", ".join(f"named_struct('value', {value}, 'before', {before}, 'after', {after}, 'path', {path}, 'label', CAST({label} AS double))" for value, before, after, label in kinds)
    return raw.selectExpr(f"inline(array({made}))")


def fit_secrets(findings: DataFrame, trees: int = 15, depth: int = 7, seed: int = 7):
    """A random forest over FEATURES of labelled findings (value, before, after, label, and path if they have one)."""
    path = F.col("path") if "path" in findings.columns else None
    made = findings.select(*_features(F.col("value"), F.col("before"), F.col("after"), path), "label").coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="sqrt").fit(rows)


def _tree(node, x: Column) -> Column:
    """One tree as nested conditions: the share of secrets in the leaf that a candidate reaches."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.impurityStats().prob(1.0)))
    split = node.split()
    return F.when(x[FEATURES[split.featureIndex()]] <= split.threshold(), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def forest_score(model, x: Column) -> Column:
    """The forest as one expression of a struct of FEATURES, so that it scores inside a row's array."""
    trees = [t._java_obj.rootNode() for t in model.trees]
    return sum((_tree(t, x) for t in trees[1:]), _tree(trees[0], x)) / len(trees)


def scan_secrets(documents: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, mark: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """All columns of ``documents``, and of each text: redacted, n_found, n_secrets, secrets.

    secrets: array of (start, length, score) of confirmed candidates, start from 0, in characters. ``path``: the column
    that names the file of a text, if there is one. Null texts give null and empty ones the empty text, with no candidates;
    repeated rows give repeated results; a candidate that occurs twice is judged at each place by its own neighbours; an
    empty table gives an empty result; columns of ``documents`` with the names of results are replaced. Nothing is
    shuffled: candidates are found, judged and cut inside their row, in time linear in the text but for the array of
    confirmed ones. Passphrases with spaces, and tokens of letters only without a telling name, are no candidates."""
    model = fit_secrets(labelled_findings(documents.sparkSession) if findings is None else findings)
    own = [c for c in documents.columns if c not in ("redacted", "n_found", "n_secrets", "secrets")]
    place = F.lit("") if path is None else F.col(f"`{path}`").cast("string")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("text"), place.alias("path"))
    found, pieces = _candidates(F.col("text"))
    rows = rows.withColumn("found", found).withColumn("pieces", pieces)

    def score(value: Column, before: Column, after: Column) -> Column:
        x = F.array(F.struct(*_features(value, before, after, F.col("path"))))
        return F.get(F.transform(x, lambda v: F.round(forest_score(model, v), 6)), F.lit(0))

    rows = rows.withColumn("judged", _judged(F.col("found"), F.col("pieces"), score))
    none = F.array().cast("array<struct<start:int,length:int,score:double>>")

    def step(a: Column, c: Column) -> Column:
        start = a["at"] + F.length(c["piece"])
        hit = F.struct(start.alias("start"), F.length(c["value"]).alias("length"), c["score"].alias("score"))
        return F.struct((start + F.length(c["value"])).alias("at"), F.when(c["score"] >= threshold, F.concat(a["out"], F.array(hit))).otherwise(a["out"]).alias("out"))

    secrets = F.aggregate("judged", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    rows = rows.withColumn("secrets", F.coalesce(secrets, none))
    parts = F.transform("judged", lambda c: F.concat(c["piece"], F.when(c["score"] >= threshold, F.lit(mark)).otherwise(c["value"])))
    return rows.select(
        *(F.col("row")[c].alias(c) for c in own),
        F.when(F.size("secrets") == 0, F.col("text")).otherwise(F.concat(F.array_join(parts, ""), F.element_at("pieces", -1))).alias("redacted"),
        F.coalesce(F.greatest(F.size("found"), F.lit(0)), F.lit(0)).cast("long").alias("n_found"),
        F.size("secrets").cast("long").alias("n_secrets"),
        "secrets",
    )
