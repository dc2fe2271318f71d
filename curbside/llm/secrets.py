"""Secret scan with a random forest that removes false positives; DataFrame and SQL functions only.

One regular expression marks candidates in whole texts: values assigned to a telling name (in code, JSON, YAML, XML,
options of commands or plain sentences), passwords in URLs, private keys, and all long runs of key characters. Each
candidate is described by its length, the transitions between kinds of characters, how much of it a small dictionary
covers, its path, and the words beside it. A random forest trained on labelled findings (``labelled_findings``,
``labelled_forms``) scores it and does all rejecting. Secrets themselves are not returned, only their digests.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, SEED, SECRET_AT = 24, 7, 42, 0.5
#: Characters beside a candidate that count as its neighbourhood.
NEAR_CHARS = 40
# Names that secrets are assigned to, words near secrets, words near false positives, common words in names.
_ASSIGNED = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|credential|pass(?<![A-Za-z]pass)(?![A-Za-z])"
# The key may be quoted, in brackets, of a stated type, or itself the value of an attribute whose neighbour is "value".
_KEY = rf"(?i:(?:{_ASSIGNED})[\w-]{{0,64}}+)(?:\\?[\"'`])?\]?"
_SIGN = r"(?:\s*+(?::=|<-|=>|={1,3}|:(?:\s{0,3}[&\w.<>\[\]?]{1,24}\s{0,3}=)?|(?i:value)\s{0,3}=)\s*+|\s++(?i:is|was)\s++)"
_OPTION = rf"(?<![\w-])--?{_KEY}[ ]++(?!-)"
# A quoted value runs to the closing quote of its line, escaped quotes included; without one, to the first white space.
_QUOTED = "|".join(
    [
        r"(\\[\"'])([^\"'\\\r\n]{4,}+(?=\\[\"'])|[^\"'\s\\]{4,})",
        r"([A-Za-z]{0,2}\")((?:[^\"\\\r\n]|\\.){4,}+(?=\")|[^\"\s]{4,})",
        r"([A-Za-z]{0,2}')((?:[^'\\\r\n]|\\.){4,}+(?=')|[^'\s]{4,})",
        r"(`)([^`\r\n]{4,}+(?=`)|[^`\s]{4,})",
    ]
)
_ELEMENT = rf"(>(?<=<[\w:.-]{{0,32}}(?i:{_ASSIGNED})[\w:.-]{{0,12}}(?:\s[^<>]{{0,200}})?>)(?<!/>)\s{{0,20}})(?:(<!\[CDATA\[)([^\s<>\]]{{4,}})|([^\s<>]{{4,}}))"
_URL = r"(://[^\s/:@\"'<>]{0,256}:)([^\s/?#\"'<>]+)(?=@)"
_PRIVATE_KEY = r"(-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----)([^-]*+(?:-(?!----)[^-]*+)*+)"
_KEY_LIKE = r"(?<![\w+/=-])(?=[_+/=-]*+[A-Za-z0-9])([\w+/=-]{20,}+)"
_BEFORE_QUOTE = r"[ \t]++(?=[A-Za-z]{0,2}[\"'`])"
CANDIDATE = rf"({_KEY}(?:{_SIGN}|{_BEFORE_QUOTE})|{_OPTION})(?:{_QUOTED}|([^\s\"'<>|]{{6,}}))|{_ELEMENT}|{_URL}|{_PRIVATE_KEY}|{_KEY_LIKE}"
#: Its groups that belong to the name and to the value; of each the ones that took no part are empty.
_NAME_GROUPS, _VALUE_GROUPS = (1, 2, 4, 6, 8, 11, 12, 15, 17), (3, 5, 7, 9, 10, 13, 14, 16, 18, 19)
_MARKED = "\x01" + "".join(f"${k}" for k in _NAME_GROUPS) + "\x03" + "".join(f"${k}" for k in _VALUE_GROUPS) + "\x02"
# How keys of well-known services begin.
_ISSUED = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|npm_|xox[abprs]-|sk[_-]|rk_|eyJ|ya29)"
_NEAR_SECRET = r"(?i)token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private"
_NEAR_FALSE = r"(?i)example|sample|placeholder|dummy|commit|revision|checksum|digest|sha.?\d|md5|etag|uuid|guid|hash|version|fingerprint|isbn|order|phone"
_TEST_PATH = r"(?i)test|example|sample|mock|fixture|doc"
_DICTIONARY = "|".join(
    sorted(
        "the and for you your this that with from here have not are was will user name pass word password token secret key api test demo example sample value change enter insert default "
        "config setting path local home lib usr bin python java script node module package version file data base http https www com org net server client admin root null none true false "
        "string number table column index page article image style class section content placeholder dummy access auth public private".split(),
        key=lambda w: (-len(w), w),
    )
)
FEATURES = ["length", "transitions", "class_mix", "digits", "uppers", "others", "distinct", "repeats", "hexes", "dictionary", "assigned", "near_secret", "near_false", "test_path", "slashes", "spaces", "vowels", "issued", "key_block"]


#: The marks that a text holds itself, and the escape character, and what stands for each while the text is searched.
_ESCAPES = [("\x04", "\x04\x08"), ("\x01", "\x04\x05"), ("\x02", "\x04\x06"), ("\x03", "\x04\x07")]


def _escaped(text: Column) -> Column:
    """``text`` without marks of its own; texts that hold none are left as they are."""
    other = text
    for char, pair in _ESCAPES:
        other = F.replace(other, F.lit(char), F.lit(pair))
    held = F.instr(text, "\x01") + F.instr(text, "\x02") + F.instr(text, "\x03") + F.instr(text, "\x04")
    return F.when(held > 0, other).otherwise(text)


def _unescaped(text: Column) -> Column:
    other = text
    for char, pair in reversed(_ESCAPES):
        other = F.replace(other, F.lit(pair), F.lit(char))
    return F.when(F.instr(text, "\x04") > 0, other).otherwise(text)


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate of every text: doc_id, nth (from 1), value, name, before, after, path."""
    text = _escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    parts = F.split(F.regexp_replace(text, CANDIDATE, _MARKED), "\x01", -1)
    marked = docs.select("doc_id", F.col("source").cast("string").alias("path"), parts.alias("parts")).filter(F.size("parts") > 1)
    each = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1),
        lambda k: F.struct(
            F.right(_unescaped(F.substring_index(F.element_at("parts", k), "\x02", -1)), F.lit(NEAR_CHARS)).alias("before"),
            F.element_at("parts", k + 1).alias("part"),
        ),
    )
    rows = marked.select("doc_id", "path", F.posexplode(each).alias("at", "found"))
    match = F.substring_index("found.part", "\x02", 1)
    name = F.substring_index(match, "\x03", 1)
    return rows.select(
        "doc_id",
        (F.col("at") + 1).alias("nth"),
        _unescaped(F.substring_index(match, "\x03", -1)).alias("value"),
        _unescaped(name).alias("name"),
        F.col("found.before").alias("before"),
        F.left(_unescaped(F.substring_index("found.part", "\x02", -1)), F.lit(NEAR_CHARS)).alias("after"),
        F.coalesce("path", F.lit("")).alias("path"),
    )


def _share(value: Column, pattern: str) -> Column:
    """Part of ``value`` that ``pattern`` covers."""
    return 1 - F.char_length(F.regexp_replace(value, pattern, "")) / F.greatest(F.lit(1), F.char_length(value))


def described(found: DataFrame) -> DataFrame:
    """Adds FEATURES, all doubles, to candidates."""
    value, size = F.col("value"), F.greatest(F.lit(1), F.char_length("value"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "_")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    around = F.concat_ws(" ", "before", "name")
    columns = {
        "length": F.log1p(F.char_length("value")),
        "transitions": (F.char_length(runs) - 1) / size,
        "class_mix": F.size(F.array_distinct(F.split(runs, ""))),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "others": _share(value, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64)),
        "repeats": 1 - F.char_length(F.regexp_replace(value, r"(.)\1+", "$1")) / size,
        "hexes": value.rlike("^[0-9a-fA-F-]+$").cast("double"),
        "dictionary": _share(F.lower(value), _DICTIONARY),
        "assigned": (F.char_length("name") > 0).cast("double"),
        "near_secret": around.rlike(_NEAR_SECRET).cast("double"),
        "near_false": F.concat_ws(" ", around, "after").rlike(_NEAR_FALSE).cast("double"),
        "test_path": F.col("path").rlike(_TEST_PATH).cast("double"),
        "slashes": _share(value, "/"),
        "spaces": _share(value, r"\s"),
        "vowels": _share(value, "(?i)[aeiou]"),
        "issued": value.rlike(_ISSUED).cast("double"),
        "key_block": F.col("name").startswith("-----BEGIN").cast("double"),
    }
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


_HEXES = "sha2(cast(id AS string), 256)"
_SIXTY = f"translate(concat(base64(unhex({_HEXES})), base64(unhex(sha2(concat('x', id), 256)))), '+/=', 'aZ9')"
_PLAIN = f"substr(translate({_HEXES}, '0123456789abcdef', 'etaoinshrdlucmfw'), 1, 24)"


_BESIDE = f"concat(substr({_PLAIN}, 1, 3), ' ', substr({_PLAIN}, 5, 6), ' ', substr({_PLAIN}, 12, 4), ' ')"


def labelled_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """Findings with label 1 (a secret) or 0: ``each`` of every kind, drawn from digests of their numbers."""
    hexes, sixty, plain, beside = _HEXES, _SIXTY, _PLAIN, _BESIDE
    mixed = f"translate({sixty}, '0123456789', 'QwErTyUiOp')"
    shouted, letters = f"upper({mixed})", f"substr(upper({mixed}), 1, 13)"
    kinds = [  # label, value, name, words before
        (1, f"substr({hexes}, 1, 40)", "token = \"", ""),
        (1, f"upper(substr({hexes}, 1, 40))", "TOKEN = \"", ""),
        (1, f"substr({hexes}, 1, 32)", "api_key: ", ""),
        (1, f"concat('AKIA', upper(substr({sixty}, 1, 16)))", "", "aws access key id "),
        (1, f"concat('ghp_', substr({sixty}, 3, 36))", "auth: ", ""),
        (1, f"concat('ghp_', substr({sixty}, 3, 36))", "", ""),
        (1, f"substr({sixty}, 5, 12)", "password = '", ""),
        (1, f"concat('sk_live_', substr({sixty}, 2, 24))", "secret: ", ""),
        (1, f"concat('eyJ', substr({sixty}, 1, 60))", "", "Authorization bearer "),
        (1, f"substr({sixty}, 1, 40)", "secret_key=", ""),
        (1, f"concat('AKIA', {letters}, substr({shouted}, 17, 3))", "", ""),
        (1, f"concat('ghp_', substr({mixed}, 1, 36))", "", ""),
        (1, f"substr({mixed}, 1, 24)", "token is ", "the "),
        (1, f"substr({hexes}, 1, 40)", "token is ", "my "),
        (1, f"concat(substr({sixty}, 1, 5), '!', substr({sixty}, 7, 4))", "--password ", "run with "),
        (1, f"concat(substr({sixty}, 1, 64), '\n', {sixty}, '\n')", "-----BEGIN RSA PRIVATE KEY-----", ""),
        (1, f"concat(substr({plain}, 1, 7), ' ', substr({plain}, 8, 5), ' ', substr({plain}, 13, 6), ' ', 10 + id % 89)", "password = \"", ""),
        (1, f"concat(substr({sixty}, 3, 8), '\\\\\"', substr({sixty}, 12, 6))", "secret: \"", ""),
        (1, f"concat(substr({plain}, 1, 7), 1 + id % 9, substr({plain}, 9, 1), id % 10)", "pass: ", "db_"),
        (1, f"substr({sixty}, 1, 20)", "apikey \"", "set "),
        (0, f"concat('Please enter your ', substr({plain}, 1, 6), ' and ', substr({plain}, 9, 7))", "password\": \"", "{\""),
        (0, f"concat('The ', substr({plain}, 2, 8), ' that you use is not valid for ', substr({plain}, 12, 5))", "token = \"", ""),
        (0, f"concat(substr({plain}, 1, 6), ' ', substr({plain}, 7, 8))", "password = \"", "label of "),
        (0, f"substr({plain}, 1, 8)", "pass: ", "mountain "),
        (0, f"substr({plain}, 1, 8)", "token \"", "expected "),
        (0, f"initcap(substr({plain}, 1, 22))", "", ""),
        (0, f"concat(substr({plain}, 1, 9), '-', substr({plain}, 11, 8), '-', substr({plain}, 2, 7))", "", "the "),
        (0, f"concat(substr({plain}, 1, 7), initcap(substr({plain}, 8, 6)), initcap(substr({plain}, 14, 8)))", "", "call "),
        (0, f"substr({plain}, 1, 9)", "password is ", "the "),
        (0, "array('required', 'invalid', 'expired.', 'missing,', 'incorrect', 'optional')[cast(id % 6 AS int)]", "token is ", "the "),
        (0, f"substr({plain}, 1, 7)", "--password ", "set "),
        (0, f"concat(substr({plain}, 1, 8), '/', substr({plain}, 9, 7), '/', substr({plain}, 3, 6), '-', substr({plain}, 1, 5))", "", "see "),
        (0, f"substr({hexes}, 1, 40)", "", "commit "),
        (0, f"substr({hexes}, 1, 40)", "", ""),
        (0, f"substr({hexes}, 1, 32)", "", "md5 checksum "),
        (0, hexes, "", "sha256 digest "),
        (0, f"regexp_replace(substr({hexes}, 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5')", "", "uuid "),
        (0, f"regexp_replace(substr({hexes}, 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5')", "", ""),
        (0, "concat(array('your_api_key_here_', 'example_token_value_', 'changeme_secret_')[cast(id % 3 AS int)], id)", "token = \"", ""),
        (0, "concat(repeat(substr('xXA*0', 1 + cast(id % 5 AS int), 1), 20 + cast(id % 9 AS int)), id % 10)", "secret = ", ""),
        (0, f"concat({plain}, id % 10)", "", ""),
        (0, f"substr({plain}, 1, 8)", "password: ", "enter the "),
        (0, f"concat('config_setting_for_', substr({plain}, 1, 9), '_', id % 100)", "", ""),
        (0, f"concat('/usr/local/lib/', substr({plain}, 1, 7), '/python3/', substr({plain}, 9, 6))", "", ""),
        (0, "concat('47', lpad(cast(id * 7919 AS string), 9, '3'), lpad(cast(id * 104729 AS string), 12, '6'))", "", "order number "),
        (0, "concat('47', lpad(cast(id * 7919 AS string), 9, '3'), lpad(cast(id * 104729 AS string), 12, '6'))", "", ""),
        (0, "concat('the_', id % 7, '_and-then-', id % 11, '-with-from_', id)", "auth: ", "see "),
        (0, "concat('=========', '------', id % 10, '______')", "", ""),
    ]
    rows = [
        f"SELECT id * {len(kinds)} + {k} AS id, {label} AS label, {value} AS value, '{name.replace(chr(39), chr(39) * 2)}' AS name, concat({beside}, '{before}') AS before, "
        f"concat(' ', {beside}) AS after, CASE WHEN id % 10 = {3 if label else 4} THEN 'tests/data' ELSE concat('src', id % 20) END AS path FROM range(0, {each}, 1, 1)"
        for k, (label, value, name, before) in enumerate(kinds)
    ]
    return spark.sql(" UNION ALL ".join(rows)).coalesce(1)


def labelled_forms(spark: SparkSession, each: int = 60, first: int = 0) -> DataFrame:
    """Findings like ``labelled_findings``, of short values in JSON, dicts, code, XML and URLs."""
    word = f"substr({_PLAIN}, 1, 6)"
    secrets = [
        f"substr({_SIXTY}, 7, 11)",
        f"concat({word}, 2 + id % 8, substr({_PLAIN}, 9, 1))",
        f"concat(upper(substr({_PLAIN}, 1, 1)), id % 10, substr({_PLAIN}, 3, 3), id % 7, substr({_PLAIN}, 7, 1), substr('!$%&#', 1 + cast(id % 5 AS int), 1), 'pass', id % 9)",
        f"concat(initcap({word}), substr('!$%&#', 1 + cast(id % 5 AS int), 1), id % 97, substr({_PLAIN}, 9, 3))",
        f"substr({_HEXES}, 1, 16)",
    ]
    others = [
        f"substr({_PLAIN}, 1, 5 + cast(id % 6 AS int))",
        "array('password', 'string', 'required', 'changeme', 'username', 'enter_password', 'your-password', 'example', 'optional', 'secret')[cast(id % 10 AS int)]",
        "concat(substr('${<%', 1 + cast(id % 3 AS int), 1), '{', array('PASSWORD', 'DB_PASSWORD', 'password', 'api_key', 'TOKEN')[cast(id % 5 AS int)], '}')",
        f"concat(array('process.env.', 'os.environ.', 'config.get_', 'self.')[cast(id % 4 AS int)], substr({_PLAIN}, 1, 5))",
        "repeat(substr('xX*.', 1 + cast(id % 4 AS int), 1), 4 + cast(id % 9 AS int))",
    ]
    places = [  # name, words before
        ("password\": \"", "{\""), ("api_key\":\"", "{\"user\": 1, \""), ("password'] = '", "config[\""), ("password := \"", ""), ("token\" => \"", "\""), ("secret: \"", ""), (">", "<password"), ("://bob:", "postgres"), ("://admin:", "see https"),
    ]
    one_of = lambda texts: "array(" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + ")[p]"
    values = " ".join(f"WHEN {v} THEN {value}" for v, value in enumerate(secrets + others))
    kinds = len(places) * len(secrets + others)
    return spark.sql(
        f"SELECT n AS id, CASE WHEN v < {len(secrets)} THEN 1 ELSE 0 END AS label, CASE v {values} END AS value, {one_of([p[0] for p in places])} AS name, concat({_BESIDE}, {one_of([p[1] for p in places])}) AS before, "
        f"concat(' ', {_BESIDE}) AS after, CASE WHEN id % 10 = CASE WHEN v < {len(secrets)} THEN 3 ELSE 4 END THEN 'tests/data' ELSE concat('src', id % 20) END AS path "
        f"FROM (SELECT id AS n, id div {kinds} AS id, cast(id % {kinds} div {len(places)} AS int) AS v, cast(id % {len(places)} AS int) AS p FROM range({first * kinds}, {(first + each) * kinds}, 1, 1))"
    )  # one SELECT: each branch of a union is compiled anew


def forest(spark: SparkSession) -> RandomForestClassificationModel:
    """Trained on all labelled findings, some thousands of rows."""
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(labelled_findings(spark).unionAll(labelled_forms(spark)).coalesce(1)).withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(assembled)


def secret_scan(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """One row for every candidate in ``docs`` (doc_id, text, source, ...): doc_id, nth (order in the text), rule,
    n_chars, value_sha256, probability, is_secret.

    ``is_secret`` is false for what the forest takes for a false positive; a probability of exactly SECRET_AT is a
    secret. A quoted value runs to the closing quote of its line and keeps spaces, escapes and control characters; an
    unquoted one ends at white space. Null and empty texts have no candidates, texts and values are read whole, however long; repeated rows and
    repeated values appear again; an empty table gives no rows; other columns are ignored. A null source is an empty path.
    """
    model = model or forest(docs.sparkSession)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(candidates(docs)))
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(vectors).withColumn("p", p)
    return scored.select(
        "doc_id",
        F.col("nth").cast("int").alias("nth"),
        F.when(F.char_length("name") > 0, "assigned").otherwise("key_like").alias("rule"),
        F.char_length("value").alias("n_chars"),
        F.sha2("value", 256).alias("value_sha256"),
        F.round("p", 6).alias("probability"),
        (F.col("p") >= SECRET_AT).alias("is_secret"),
    )
