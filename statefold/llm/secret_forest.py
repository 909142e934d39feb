"""Secret scan with a random forest that removes false positives.

Candidates are maximal runs of 16 or more key-like characters with a digit, in which "=" can only be padding at the end, so
that a NAME= stays in the text before; tokens of several parts with known beginnings; and values of 6 or more characters
of any kind that are assigned to an asking name. Their numbers (length, classes of characters
and changes between them, dictionary coverage, path-likeness, neighbouring words) are SQL expressions; a random forest
trained from labelled findings decides. Everything runs in the JVM: expressions, the forest's training and its scores.

Cases: null and empty texts have no candidates; repeated rows and null ids are scanned each; an empty table gives no rows.
Texts are read whole and candidates have no greatest length. An empty or one-sided table of labelled findings gives a
forest that knows one answer.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statefold.llm.common import materialize

#: A whole run of these characters with a digit; "=" ends it as padding, and a run that "=" makes the name of a value is none.
KEY = r"[A-Za-z0-9+/_\-]"
RUN = rf"(?<!{KEY})(?={KEY}{{16}}|{KEY}{{15}}=|{KEY}{{14}}==)(?=[A-Za-z+/_\-]*[0-9]){KEY}{{14,}}+(?:={{1,2}}(?!=|[\"'`]?{KEY}))?+(?!=)"
#: Tokens of several parts.
DOTTED = r"(?<![A-Za-z0-9+/_.\-])(?:eyJ[A-Za-z0-9_\-]{6,}+|SG|hvs|ya29)(?:\.[A-Za-z0-9_\-]{8,}+){1,4}+"
#: A value assigned to an asking name, up to a blank, quote or bracket, unless it is called or indexed. The short looks behind come first for speed.
ASKING_NAME = r"(?i:secret(?!ar)|token(?!i[sz])|passw|passphrase|pwd|api.?key|access.?key|auth(?!or(?!i))|credential|private.?key|client.?key)[A-Za-z0-9_\-]{0,16}"
ASSIGNED = rf"{ASKING_NAME}[\"'`]?[ \t]{{0,2}}(?:=>|:=|={{1,3}}|:)[ \t]{{0,2}}[\"'`]?"
BEARER = r"(?i:bearer)[ \t]{1,2}"
ASKED = rf"(?<=[=:> \t\"'`])(?<=[=:>][ \t\"'`]{{0,3}}|{BEARER})(?<={ASSIGNED}|{BEARER})(?![=:>])(?>[^\s\"'`,;<>(){{}}\[\]&|\\]{{5,}}[^\s\"'`,;<>(){{}}\[\]&|\\.])(?![(\[])"
CANDIDATE = f"(?:{ASKED}|{DOTTED}|{RUN})"
#: Characters of context that the numbers look at, before and after.
BEFORE, AFTER = 48, 24
MASK = "<SECRET>"
#: Fixed words: what makes names, not keys.
DICTIONARY = (
    "user local share lib bin python site packages node modules src main test tests docs build dist public static assets image images index "
    "config settings default version release file files data table example sample your here placeholder changeme license apache mozilla "
    "name number value class method function object string array list http https www com org net html page post blog article news "
    "this that with from have will would about there their which when what where report update service server client request response "
    "model train layer batch project module package import export content header footer style script"
).split()
ASKING = r"(secret|token|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|client.?key)"
NAMING = r"(sha-?\d*|commit|md5|checksum|digest|hash|uuid|guid|etag|integrity|revision|base64,|build|version|isbn|order|phone|card)"
#: What stands where a secret is to be filled in, and names of types.
DUMMY = r"(your|example|placeholder|change.?me|dummy|sample|xxx|\*\*\*|\$|%|todo|insert|redacted|none|null|true|false|required|optional|string|hidden|empty|secret|password|token)"
#: Fixed beginnings of keys of known issuers.
ISSUED = r"^(AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abprs]-|AIza|glpat-|npm_|SG\.|eyJ)"


def numbers() -> dict[str, Column]:
    """The forest's inputs from columns candidate, before and after."""
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    upper, lower, digit = ("".join(map(chr, range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
    kinds = F.translate(c, upper + lower + digit + "+/_=-", "u" * 26 + "l" * 26 + "d" * 10 + "o" * 5)
    share = lambda chars: (n - F.length(F.translate(c, chars, ""))) / n
    low, before, after = F.lower(c), F.lower(F.col("before")), F.col("after")
    flag = lambda x: x.cast("double")
    return {
        "length": F.least(n, F.lit(400.0)),
        "digits": share(digit),
        "upper": share(upper),
        "lower": share(lower),
        "other": share("+/_=-"),
        "changes": F.regexp_count(kinds, F.lit("(?<=l)[^l]|(?<=u)[^u]|(?<=d)[^d]|(?<=o)[^o]")) / n,
        "spoken": F.regexp_count(low, F.lit("(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]|(?<=[bcdfghjklmnpqrstvwxyz])[aeiou]")) / n,
        "letter_runs": F.length(F.regexp_replace(low, "(?<![a-z])[a-z]{1,3}(?![a-z])|[^a-z]", "")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "hex": flag(low.rlike("^[0-9a-f]+$")),
        "dashed": flag(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "repeats": F.regexp_count(c, F.lit(r"(.)\1")) / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, "(" + "|".join(DICTIONARY) + ")", "")) / n,
        "slashes": F.length(c) - F.length(F.translate(c, "/", "")),
        "joins": (n - F.length(F.translate(c, "_-", ""))) / n,
        "path": flag(F.col("before").rlike(r"[/.~:]$") | after.rlike(r"^[/.]\w")),
        "issued": flag(c.rlike(ISSUED)),
        "asked": flag(before.rlike(ASKING)),
        "asked_next": flag(before.rlike(ASKING + r"\W{0,12}$")),
        "named_next": flag(before.rlike(r"\b" + NAMING + r"\W{0,12}$")),
        "assigned": flag(before.rlike(r"(=|:|=>|bearer)\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike("^[\"'`]")),
        "equals": flag(before.rlike(r"=>?\s*[\"'`]?$")),
        "password": flag(before.rlike(r"(passw|pwd|passphrase)\w*[\"'`]?\W{0,6}$")),
        "dummy": flag(low.rlike(DUMMY)),
        "dots": F.length(c) - F.length(F.translate(c, ".", "")),
        "marks": F.regexp_count(c, F.lit(r"[^A-Za-z0-9+/_=.\-]")),
    }


NAMES = tuple("length digits upper lower other changes spoken letter_runs distinct hex dashed repeats dictionary slashes joins path issued asked asked_next named_next assigned quoted equals password dummy dots marks".split())


def split_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, position, piece, candidate: texts with candidates, cut into the text before each candidate and the candidate.

    The last piece of a text has no candidate.
    """
    cut = docs.select(*keep, F.split("text", CANDIDATE, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("candidates"))
    return cut.select(*keep, F.posexplode(F.arrays_zip("pieces", "candidates")).alias("position", "x")).select(
        *keep, "position", F.col("x.pieces").alias("piece"), F.col("x.candidates").alias("candidate")
    )


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row, ``keep``, position, start, candidate, before, after; ``start`` counts characters from 0."""
    some = docs.select(*keep, "text", F.monotonically_increasing_id().alias("row")).where(F.col("text").rlike(CANDIDATE))
    order = Window.partitionBy("row").orderBy("position")
    size = F.length("piece") + F.coalesce(F.length("candidate"), F.lit(0))
    rows = split_rows(some, ("row", *keep)).select(
        "row", *keep, "position", "candidate", size.alias("size"), F.substring("piece", -BEFORE, BEFORE).alias("before"), F.substring("piece", 1, AFTER).alias("head")
    )
    placed = rows.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.lead("head").over(order))
    found = placed.where(F.col("candidate").isNotNull())
    return found.select("row", *keep, "position", (F.col("end") - F.length("candidate")).alias("start"), "candidate", "before", "after")


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """candidate, before, after, label: findings in texts made from rules, each kind as often; a bounded table for training.

    The texts are cut as those to be scanned are, and what is found in them is positive if it is in a made secret or has it inside.
    """
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(h("a"), h("b")))), "[+/=\\r\\n]", "")
    raw64 = F.regexp_replace(F.base64(F.unhex(F.concat(h("c"), h("d")))), "[\\r\\n]", "")
    hexes = pick("hex", F.substring(h("e"), 1, 32), F.substring(h("e"), 1, 40), h("e"), F.upper(F.substring(h("e"), 1, 40)))
    word = lambda salt: pick(salt, *DICTIONARY)
    prose = pick("prose", "of the erat ", "und die ", "que la ", "in. ", "and then, ", "")
    asks = pick("ask", "token = ", "token: ", "TOKEN = ", "api_key = ", "apikey: ", "secret = ", "client_secret: ", "password = ", "auth_token=", "Authorization: Bearer ", "access_key => ", "private_key = ")
    names = pick("name", "commit ", "sha1: ", "sha256 = ", "md5=", "checksum: ", "digest = ", "etag: ", "revision ", "hash = ", "build ", "uuid: ")
    quote = pick("quote", '"', '"', "'", "")
    dashed = F.concat_ws("-", *[F.substring(h("u"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    digits = F.substring(F.conv(F.substring(h("n"), 1, 15), 16, 10), 1, 16)
    parts = [word("v"), word("w"), F.initcap(word("x")), F.concat(word("y"), F.pmod("id", F.lit(31)).cast("string"))]
    joined = pick("join", *[F.concat_ws(x, *parts) for x in ("_", "-", "")])
    settings = pick("set", "API_KEY=", "auth_token=", "AWS_SECRET_ACCESS_KEY=", "SECRET_KEY_BASE=", "export TOKEN=", "DB_PASSWORD=", "client_secret=", "GITHUB_TOKEN=", "?access_token=", "apikey=", "-e PRIVATE_KEY=")
    others = pick("other", "COMMIT=", "git_sha=", "sha256=", "REVISION=", "build_id=", "md5=", "checksum=", "ETAG=", "?id=", "order_id=")
    passwords = pick("pass", "password = ", "PASSWORD=", "passwd: ", '"password": ', "db_password=", "pwd=", "MYSQL_PWD=", "root_password: ", "secret = ", "passphrase = ", "password=")
    spoken = lambda salt, a, z: F.substring(F.translate(h(salt), "0123456789abcdef", "aeioubdfglmnprst"), 1, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(z - a)).cast("int") + a)
    marked = F.concat(F.initcap(spoken("m", 5, 10)), pick("mark", "!", "@", "#", "-", ""), F.pmod("id", F.lit(9973)).cast("string"), pick("mark2", "!", "", "?", "*"))
    secrets = pick("word", marked, F.substring(mixed, 1, 10), F.substring(mixed, 5, 14), F.regexp_replace(F.substring(mixed, 1, 30), "[0-9]", ""), spoken("s", 8, 24))
    stops = pick("stop", "\n", " ", "&x=1", "", ";")
    jwt = F.concat(F.lit("eyJ"), F.substring(mixed, 1, 17), F.lit(".eyJ"), F.substring(raw64, 1, 40), F.lit("."), F.substring(F.concat(mixed, mixed), 1, 43))
    jwt = F.translate(jwt, "+/=", "-_")
    issued = pick("issued", F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(F.lit("xoxb-"), digits, F.lit("-"), F.substring(mixed, 1, 24)))
    dummies = pick("dummies", "your_password", "changeme", "your-token-here", "placeholder", "example", "xxxxxxxx", "********", "${DB_PASSWORD}", "$TOKEN", "required", "string", "undefined", "password", "optional", "disabled")
    looked_up = F.concat(pick("object", "self.", "config.", "request.", "settings.", "os.environ.", "args.", "this.props."), pick("member", "token", "password", "secret", "auth_token", "api_key", "headers", "credentials"))
    kinds = [
        (F.concat(prose, settings), pick("value", hexes, F.substring(mixed, 1, 40), F.substring(raw64, 1, 44), F.substring(mixed, 1, 20)), stops, 1),
        (F.concat(prose, pick("any_set", settings, others, F.lit("KEY="))), issued, stops, 1),
        (F.concat(prose, pick("jwt", asks, settings, F.lit("Authorization: Bearer "), F.lit("cookie "), F.lit('"'))), jwt, pick("jwt_stop", " ", '"', "\n"), 1),
        (F.concat(prose, passwords, F.lit('"')), secrets, F.lit('"'), 1),
        (F.concat(prose, passwords), pick("bare", marked, F.substring(mixed, 1, 12), F.substring(mixed, 5, 8)), stops, 1),
        (F.concat(prose, settings), pick("short", F.substring(mixed, 1, 10), F.substring(h("k"), 1, 12), marked), stops, 1),
        (F.concat(prose, others), pick("value0", hexes, dashed, digits, F.substring(h("k"), 1, 24)), stops, 0),
        (F.concat(prose, pick("asking0", passwords, settings, asks), quote), dummies, quote, 0),
        (F.concat(prose, pick("asking1", passwords, settings, asks)), looked_up, pick("end", "\n", ",", ")", " "), 0),
        (F.concat(prose, pick("prose0", "password: ", "token: ", "secret: ", "the bearer ", "Auth: ", "credentials: ", "passwords: ")), pick("said", F.concat(word("d"), word("e")), spoken("q", 6, 12)), pick("prose1", " of the", " and ", ", which"), 0),
        (F.concat(prose, asks, quote), hexes, quote, 1),
        (F.concat(prose, asks, quote), F.substring(mixed, 1, 40), quote, 1),
        (F.concat(prose, asks, quote), F.substring(raw64, 1, 44), quote, 1),
        (F.concat(prose, pick("any", "", "key ", "= ", '"'), F.lit("")), issued, F.lit(" "), 1),
        (F.concat(prose, names, quote), hexes, quote, 0),
        (F.concat(prose, pick("id", "id=", "", "uuid: ", "request ")), dashed, F.lit(" "), 0),
        (F.concat(prose, pick("tel", "", "card ", "order ", "phone: ")), F.lpad(digits, 16, "4"), F.lit(" the"), 0),
        (F.concat(prose, pick("root", "/", "https://example.com/", "~/", "")), F.concat_ws("/", word("p"), word("q"), F.concat(word("r"), F.pmod("id", F.lit(97)).cast("string")), word("s")), pick("ext", ".html", ".py", " ", "/"), 0),
        (prose, joined, F.lit(" "), 0),
        (F.concat(prose, asks, quote), pick("dummy", F.repeat(F.substring(h("z"), 1, 1), 24), F.concat(F.lit("your_api_key_here_"), F.pmod("id", F.lit(89)).cast("string")), F.concat(F.lit("example-token-placeholder-"), F.pmod("id", F.lit(83)).cast("string"))), quote, 0),
        (prose, hexes, F.lit(" "), 0),
        (F.concat(prose, F.lit("data:image/png;base64,")), F.concat(raw64, mixed, raw64, mixed, raw64), F.lit('"'), 0),
    ]
    made = F.lit(None)
    for k, (before, candidate, after, label) in enumerate(kinds):
        made = F.when(F.pmod("id", F.lit(len(kinds))) == k, F.struct(before.alias("before"), candidate.alias("candidate"), after.alias("after"), F.lit(label).cast("double").alias("label"))).otherwise(made)
    # Written before they are cut: the rules are a large expression, which plans would repeat.
    texts = materialize(spark.range(rows).select(made.alias("x")), "made-texts").select("x.label", F.col("x.candidate").alias("made"), F.concat("x.before", "x.candidate", "x.after").alias("text"))
    found = candidates(texts, ("label", "made"))
    meant = F.contains("made", "candidate") | F.contains("candidate", "made")
    return materialize(found.select("candidate", "before", F.coalesce("after", F.lit("")).alias("after"), F.when(meant, F.col("label")).otherwise(0.0).alias("label")), "labelled-findings")


def with_vector(rows: DataFrame) -> DataFrame:
    made = numbers()
    return VectorAssembler(inputCols=[f"_{k}" for k in NAMES], outputCol="vector").transform(rows.withColumns({f"_{k}": made[k].cast("double") for k in NAMES})).drop(*[f"_{k}" for k in NAMES])


def fit(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, label)."""
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(with_vector(findings))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, candidate, score and is_secret of every candidate in ``docs``."""
    scored = model.transform(with_vector(candidates(docs))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("row", "position", "doc_id", "start", F.length("candidate").alias("length"), "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def findings(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    return scan(docs, model, threshold).drop("row", "position")


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; n_chars, where there is one, follows. All rows are kept."""
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    some = materialize(docs.where(has).withColumn("_row", F.monotonically_increasing_id()), "with-candidates")
    pieces = split_rows(some, ("_row",))
    order = Window.partitionBy("_row").orderBy("position")
    seen = pieces.withColumn("before", F.substring("piece", -BEFORE, BEFORE)).withColumn("after", F.lead(F.substring("piece", 1, AFTER)).over(order))
    # The last piece has no candidate and is scored as an empty word, which never counts.
    scored = model.transform(with_vector(seen.withColumn("real", F.col("candidate").isNotNull()).withColumn("candidate", F.coalesce("candidate", F.lit(""))).fillna("", ["before", "after"])).fillna(0.0))
    secret = F.col("real") & (vector_to_array("probability")[1] >= threshold)
    out = scored.select("_row", "position", F.concat("piece", F.when(secret, F.lit(mask)).otherwise(F.col("candidate"))).alias("part"))
    texts = out.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda x: x["part"]), "").alias("_text"))
    changed = some.join(texts, "_row").withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~has).unionByName(changed.select(*docs.columns))
