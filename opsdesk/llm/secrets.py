"""Secret scans: candidate strings judged by a random forest, in DataFrame and Spark ML functions only.

A candidate is a blank-free token of ``min_chars`` characters or more, or of ``min_named`` or more where a name with ``=`` or
``:`` stands before it, in the token or as the word before; the name and quotes around the value are taken off. Its features are length, character transitions (between lower case, upper case, digits and other
characters, and between vowels and consonants), shares of character kinds, dictionary coverage, what its path says
(tests, examples, documentation) and what the neighbouring words and the name say (words for credentials, words for
checksums and identifiers). The forest is trained from labelled findings: a table of token, before, path and label.
``labelled_findings`` makes one by rule from templates of real key formats and of the usual false positives; a user's own
review decisions can be added to it or replace it.

Values aren't echoed: results carry a masked form and a digest.

Defined results: null and empty texts have no candidates; of repeated rows each gives its own; null paths count as
empty; a text of any length is scanned whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word lists of the features.
CREDENTIAL_WORDS = "key|token|secret|passw|pwd|auth|cred|bearer|api|private|access|login|signature|cookie|session"
IDENTIFIER_WORDS = "commit|sha|md5|hash|checksum|digest|uuid|guid|revision|version|build|etag|request|trace|path|file|url|href|image|page"
SAMPLE_PATHS = "test|spec|example|sample|fixture|mock|doc|readme|demo|tutorial"
DICTIONARY = (
    "able account access action active address admin agent application array author backup base before begin block body branch buffer build "
    "button cache call change channel char check class client cloud code color column comment commit common config connect content context "
    "control copy count create current data date debug default delete detail device display document domain download element email enable end "
    "error event example export extra factory field file filter final find first folder font format frame from function get global group handle "
    "header heading height help here host image import index info input insert install integer internal item java job json key label language "
    "last layer layout length level library license light like limit line link list local location lock log login main manager map master match "
    "max media member memory menu message meta method min mode model module monitor name network new node normal note null number object offset "
    "open option order output package page panel parent parse part password path pattern payload place plugin point policy pool port position "
    "post prefix print private process product profile project property provider public query queue read record region remote remove render "
    "replace report request require reset resource response result return role root route row rule run sample scale scope score script search "
    "second secret section select send server service session set setting shape share show side sign single size sort source space special "
    "stack start state static status step stop storage store stream string style subject submit success support switch symbol sync system table "
    "tag target task template test text theme thing this time title token tool track tree trigger type union unit update upload user value "
    "version video view visible watch widget width window with word work write your zone"
).split()
#: What stands between the name of a header and its credential.
SCHEMES = "bearer|basic|digest|negotiate"
FEATURES = ("length", "transitions", "vowel_changes", "digits", "uppers", "others", "distinct", "longest_lower", "hex", "covered", "placeholder", "path_like", "sample_path", "credential_near", "identifier_near", "named")


def candidates(documents: DataFrame, *, path: str = "source", min_chars: int = 16, min_named: int = 6) -> DataFrame:
    """doc_id, nth (from 0), token, before (up to two short words), path of every candidate."""
    opening = r"[({\[\"']{0,3}"
    value = rf"[\"']?(?!//|=)[^\s\"']\S{{{min_named - 1},}}"
    named = rf"[A-Za-z_][\w.\-]*[\"']?[:=]{value}"
    after = rf"[A-Za-z_][\w.\-]*[\"']?[ \t]{{0,20}}[:=]\s{{1,20}}{value}"
    pattern = rf"(?<!\S)(?:\S{{1,{min_chars - 1}}}[ \t]+){{0,2}}?(?:{opening}{after}|\S{{{min_chars},}}|{opening}{named})"
    found = documents.where("text is not null").select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("nth", "found"))
    return found.select("doc_id", "nth", "path", F.regexp_extract("found", r"(\S+)$", 1).alias("token"), F.regexp_extract("found", r"(?s)^(.*?)\S+$", 1).alias("before"))


def parts(found: DataFrame) -> DataFrame:
    """Adds name and value. A value after a name and its = or :, with or without blanks and a line end between, goes to its closing quote, or
    to the next blank, whatever is in it; a token without name is its own value, without the marks around it."""
    bare = F.regexp_replace("token", r"""^[^\p{L}\p{N}/_+.$~\-]+|[^\p{L}\p{N}/_+=]+$""", "")
    before = F.regexp_extract("before", r"""([A-Za-z_][\w.\-]{0,60})["']?[ \t]*[:=]\s*$""", 1)
    quoted = F.regexp_extract("token", r"""^["']([^"']+)["']""", 1)
    assigned = r"""^([A-Za-z_][\w.\-]{0,60})["']?[:=]["']?((?!//)[^:=]\S*)$"""
    inner = F.regexp_extract("token", r"""^[({\["']{0,3}[A-Za-z_][\w.\-]{0,60}["']?[:=]["']([^"']+)["']""", 1)
    own = F.regexp_extract(bare, assigned, 1)
    name = F.when(before != "", before).otherwise(own)
    value = F.when((before != "") & (quoted != ""), quoted).when((before != "") | (own == ""), bare).when(inner != "", inner).otherwise(F.regexp_extract(bare, assigned, 2))
    return found.withColumn("name", name).withColumn("value", value)


def featured(found: DataFrame) -> DataFrame:
    """found (token, before, path) with a column for each of FEATURES."""
    x = parts(found)
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\p{Ll}", "a"), r"\p{Lu}", "B"), r"\p{Nd}", "0"), "[^aB0]", "-")
    sound = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}]", ""), r"[^aeiouyáàâäéèêëíîïóôöúùûü]", "b")
    sound = F.regexp_replace(sound, "[^b]", "a")
    runs = lambda s: F.greatest(F.length(F.regexp_replace(s, r"(.)\1+", "$1")) - 1, F.lit(0))
    share = lambda c: F.length(F.regexp_replace("kinds", f"[^{c}]", "")) / n
    near = F.lower(F.concat_ws(" ", "before", "name"))
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True))
    x = x.withColumn("kinds", kinds).withColumn("sound", sound)
    columns = {
        "length": F.length(v).cast("double"),
        "transitions": runs(F.col("kinds")) / n,
        "vowel_changes": runs(F.col("sound")) / F.greatest(F.length("sound"), F.lit(1)),
        "digits": share("0"),
        "uppers": share("B"),
        "others": share("\\-"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "longest_lower": F.array_max(F.transform(F.split("kinds", "[^a]"), F.length)).cast("double") / n,
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(low, f"(?:{words})", "")) / n,
        "placeholder": (low.rlike(r"example|sample|dummy|changeme|placeholder|your[_\-]?|xxxx|0000|1234|<.*>|\$\{|%\(|\{\{") | v.rlike(r"(.)\1{5,}")).cast("double"),
        "path_like": v.rlike(r"://|^\.{0,2}/|@|\.\w{1,4}$|\w/\w+/\w").cast("double"),
        "sample_path": F.lower("path").rlike(SAMPLE_PATHS).cast("double"),
        "credential_near": near.rlike(CREDENTIAL_WORDS).cast("double"),
        "identifier_near": near.rlike(IDENTIFIER_WORDS).cast("double"),
        "named": (F.col("name") != "").cast("double"),
    }
    return x.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in columns.items()}).drop("kinds", "sound")


def labelled_findings(spark: SparkSession, n: int = 8_000) -> DataFrame:
    """token, before, path, label: n findings made by rule, half of them secrets."""
    h = lambda k: F.sha2(F.concat_ws(":", F.col("id"), F.lit(k)), 512)
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), r"[^A-Za-z0-9]", "x")
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    syllables = [F.lit(s) for s in "th er in an re ti ion ent lich keit ung schaft que tion eux ment ado osa mente cia por ver ein be ge sch ing ed ble or st".split()]
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.pmod(F.xxhash64("id", F.lit(90)), F.lit(5)) + 5), lambda i: F.element_at(F.array(*syllables), (F.pmod(F.xxhash64("id", i), F.lit(len(syllables))) + 1).cast("int"))), "")
    name = pick(1, "token", "password", "api_key", "secret", "auth_token", "access_key", "client_secret", "passwd")
    size = (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(30)) + 16).cast("int")
    hexes, mixed = F.substring(h(3), F.lit(1), size), F.substring(b64(4), F.lit(1), size)
    prose, odd = pick(5, "the new", "of a", "und der", "que la", "", "und die Datei"), pick(6, "commit", "sha256", "md5 checksum", "request id", "build", "revision", "file hash")
    place = pick(7, "src/app.py", "config/prod.yml", "src3", "forum", "deploy/.env", "notes.txt")
    sample = pick(8, "tests/fixtures/keys.py", "docs/README.md", "examples/demo.yml", "src3", "src/app.py")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    digits = F.substring(F.regexp_replace(h(31), "[a-f]", ""), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(32)), F.lit(3)) + 1).cast("int"))
    short = F.concat(F.initcap(F.substring(word, 1, 6)), digits, pick(33, "!", "#", "&3", "", "_x"))
    tiny = F.substring(b64(34), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(35)), F.lit(8)) + 7).cast("int"))
    field = pick(36, "note: ", "color = ", "title: ", "status: ", "city: ", "name: ", "the following: ", "date: ")
    yes = [
        (short, F.concat(pick(37, "password", "passwd", "secret", "pwd"), F.lit(": "))), (F.concat(pick(38, "password", "pwd", "secret"), F.lit("="), short), prose), (tiny, F.concat(name, F.lit(" = "))), (F.concat(name, F.lit(":"), tiny), prose),
        (quoted(hexes), F.concat(name, F.lit(" = "))), (F.concat(name, F.lit("="), hexes), prose), (F.concat(name, F.lit(":"), mixed), prose), (quoted(mixed), F.concat(name, F.lit(" : "))),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(b64(9), 1, 16))), prose), (F.concat(pick(10, "ghp_", "sk_live_", "xoxb-", "glpat-"), F.substring(b64(11), 1, 36)), prose),
        (F.concat(F.lit("eyJ"), F.substring(b64(12), 1, 30), F.lit("."), F.substring(b64(13), 1, 40), F.lit("."), F.substring(b64(14), 1, 40)), F.lit("bearer ")),
        (F.substring(b64(15), 1, 40), F.concat(name, F.lit(" is "))),
    ]
    no = [
        (F.substring(word, 1, 9), field), (F.concat(F.initcap(F.substring(word, 1, 8)), F.lit(",")), field), (F.concat(pick(39, "color", "title", "lang", "mode"), F.lit("="), F.substring(word, 1, 8)), prose), (pick(41, "2024-01-05", "12:30:45", "1,250.00", "v1.2.13", "#ff8800", "true;", "localhost:8080"), field),
        (F.substring(word, 1, 9), F.concat(name, F.lit(": "))), (F.concat(F.lit("("), F.substring(word, 1, 8), F.lit(")")), F.concat(name, F.lit(" = "))),
        (word, prose), (F.upper(word), prose), (F.concat(F.upper(word), F.lit("!!")), prose), (F.concat(word, F.lit("&amp;"), word), prose), (F.concat_ws("-", word, F.lit("und"), word), prose), (F.concat(F.initcap(word), F.lit(",")), prose), (F.concat(word, F.lit("="), word), prose),
        (F.substring(h(16), 1, 40), odd), (F.substring(h(17), 1, 32), odd), (F.regexp_replace(F.substring(h(18), 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), pick(19, "request id", "uuid", "the new", "trace")),
        (F.concat(pick(20, "https://", "http://www."), word, F.lit(".example.com/"), F.substring(h(21), 1, 12)), prose), (F.concat(word, F.lit(".12@mail."), word, F.lit(".com")), prose),
        (F.concat(F.lit("/usr/lib/"), word, F.lit("/module.so")), prose), (F.concat(F.substring(F.regexp_replace(h(22), "[a-f]", "7"), 1, 17), F.lit("")), prose),
        (F.concat(name, F.lit("="), pick(23, "your_api_key_here", "changeme_changeme", "xxxxxxxxxxxxxxxxxxxx", "${SECRET_FROM_ENV}", "EXAMPLEKEYEXAMPLEKEY", "<insert_token_here>")), prose),
        (F.concat(name, F.lit("="), pick(24, "get_token_from_environment", "load_private_key_file", "settings.default_value", "request.session.user")), prose),
        (F.concat_ws("_", pick(25, "default", "current", "user", "config"), pick(26, "service", "request", "session", "template"), pick(27, "handler", "manager", "value", "version")), prose),
    ]
    kind = F.pmod(F.xxhash64("id", F.lit(30)), F.lit(1_000))
    struct = lambda pair, label, where: F.struct(pair[0].alias("token"), pair[1].alias("before"), where.alias("path"), F.lit(label).alias("label"))
    chosen = F.when(F.col("id") % 2 == 0, F.element_at(F.array(*[struct(p, 1.0, place) for p in yes]), (kind % len(yes) + 1).cast("int"))).otherwise(
        F.element_at(F.array(*[struct(p, 0.0, F.when(F.col("id") % 4 == 1, sample).otherwise(place)) for p in no]), (kind % len(no) + 1).cast("int"))
    )
    return spark.range(n).select(chosen.alias("x")).select("x.*")


def fit(findings: DataFrame, *, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (token, before, path, label 0 or 1)."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(findings.where("label in (0, 1)"))).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(vectors).copy()  # without the training summary, which holds the session


def scan(documents: DataFrame, model: RandomForestClassificationModel, *, path: str = "source", min_chars: int = 16, min_named: int = 6, threshold: float = 0.5) -> DataFrame:
    """doc_id, nth, name, masked, digest, length, score (0 to 1) and secret (score >= threshold) of every candidate but the
    scheme of a header (Authorization: Bearer), which is no value; what follows it is a candidate of its own."""
    scheme = rf"""(?i)^[^A-Za-z]*(?:[A-Za-z_][\w.\-]*["']?[:=]["']?)?(?:{SCHEMES})[^A-Za-z0-9]*$"""
    found = featured(candidates(documents, path=path, min_chars=min_chars, min_named=min_named).where(~F.col("token").rlike(scheme)))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    score: Column = F.element_at(vector_to_array("probability"), 2)
    masked = F.concat(F.substring("value", 1, 3), F.lit("***"))
    return scored.select("doc_id", "nth", "name", masked.alias("masked"), F.sha2("value", 256).alias("digest"), F.length("value").alias("length"), score.alias("score"), (score >= threshold).alias("secret"))
