"""Secret scanning with a random forest that removes false positives, in DataFrame functions only.

Candidates are matches of PATTERN: private key blocks, values assigned to a telling name, and runs of
16 or more token characters with a digit among them. Each has features from its length, character
classes and transitions, dictionary coverage, the document's path and the words around it. A random
forest trained on labelled findings scores them: its trees are compiled to one SQL expression, so a
scan is a projection without a shuffle, a join or Python.

Null text has no candidates; a null path counts as empty. Every match in a text of any length is
scored; equal candidates at different places are scored each in their place. Repeated rows are scanned each
for itself, ids may be null, an empty table gives no rows, and columns of docs may have any names.
"""

from __future__ import annotations

import json
import random
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import freed, held

CUT = 0.5
TREES = 25
DEPTH = 6
MASK = "[SECRET]"

# Names that secrets are assigned to, words beside values that are none, known prefixes.
NAMES = "access_?key|api_?key|apikey|auth|bearer|client_?secret|credential|passwd|password|private_?key|pwd|secret|secret_?key|token"
HARMLESS = "checksum|commit|digest|etag|guid|hash|id|md5|ref|revision|sha|sha1|sha256|uuid|version"
PREFIXES = "AIza|AKIA|ASIA|eyJ|gh[opsu]_|glpat-|sk-|sk_live_|xox[abprs]-"
TEST_PATHS = "docs?|example|fixture|mock|sample|spec|test"
DICTIONARY = """
    about access account action address admin after again agent alpha array article author backup banner base before beta blog board
    body book build button cache call camera card case center change chart check city class client cloud code color column company
    config contact content control copy count country course cover create data date default delete demo design detail device docs
    document down draft edit email error event example export field file filter final find first folder font form format forum from
    game gallery garden global graph green group guide have header health here history home host house image import index info input
    item key lang large layout level light line link list live load local login logo long mail main make manager map market master
    media member menu message method mobile model module month movie music name network news next node note number object office
    online open option order other output owner page paper parent part password path photo picture place plan player plugin point
    policy popular port portal post power price print private product profile program project public query queue random report
    request reset result review root rule sample save school screen script search secret section select sender series server service
    session setting share sheet shop show sign simple site size small social some sort source space sport stage standard start state
    static status stock store story street style subject submit summary support system table team template test text that theme
    this thread time title token tool total track travel tree type under unit update upload user value version video view water week
    white will window with word work world year your
""".split()

# The short look-behinds come first: they rule out nearly every place before the names are tried.
PATTERN = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_+/=\-])(?=[A-Za-z_+/=\-]*+[0-9])[A-Za-z0-9_+/=\-]{16,}+"
    r"|(?<=[:=\s\"'])(?=[^\s\"'<>,;]{8})(?<=[:=]\s{0,3}[\"']{0,1})"
    rf"(?<=(?i:{NAMES.replace('?', '{0,1}')})[\"']{{0,1}}\s{{0,3}}[:=]\s{{0,3}}[\"']{{0,1}})[^\s\"'<>,;]{{8,}}+"
)
BEFORE, AFTER = 48, 24


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _share(pattern: str) -> str:
    return f"1 - length(regexp_replace(v, {_text(pattern)}, '')) / length(v)"


# Of a candidate v with the text before and after it and its path: name -> SQL.
FEATURES = {
    "length": "least(length(v), 400)",
    "digits": _share("[0-9]"),
    "upper": _share("[A-Z]"),
    "marks": _share("[A-Za-z0-9]"),
    "runs": f"length(regexp_replace(v, {_text('[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+')}, 'x')) / length(v)",
    "syllables": _share("(?i)[bcdfghjklmnpqrstvwxyz][aeiou]"),
    "repeats": _share(r"(.)\1{2,}"),
    "distinct": "size(array_distinct(split(v, ''))) / least(length(v), 64)",
    "words": _share("(?i)(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
    "hex": f"cast(v rlike {_text('^[0-9A-Fa-f]+$')} as int)",
    "uuid": f"cast(v rlike {_text('(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')} as int)",
    "prefix": f"cast(v rlike {_text(f'^(?:{PREFIXES})|PRIVATE KEY')} as int)",
    "placeholder": f"cast(v rlike {_text('(?i)example|your|change.?me|placeholder|dummy|xxxx|sample|test|0000|1234')} as int)",
    "assigned": "cast(before rlike " + _text(rf"(?i)(?:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?$") + " as int)",
    "named": "cast(before rlike " + _text(rf"(?i)(?:{NAMES})") + " as int)",
    "harmless": "cast(before rlike " + _text(rf"(?i)\b(?:{HARMLESS})[\"']?\W{{0,4}}$") + " as int)",
    "quoted": "cast(before rlike " + _text("[\"']$") + " and after rlike " + _text("^[\"']") + " as int)",
    "inside_url": "cast(before rlike " + _text(r"(?:://|www\.|[/.?&])\S*$") + " as int)",
    "file": "cast(after rlike " + _text(r"^\.[a-z]{2,5}\b") + " as int)",
    "slashes": _share("[/]"),
    "test_path": "cast(path rlike " + _text(f"(?i)(?:{TEST_PATHS})") + " as int)",
}


def labelled_findings(rows: int = 4000, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, label) to train on where a caller has none."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    word = lambda: rng.choice(DICTIONARY)
    made_up = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 6)))
    names = [n.replace("_?", rng.choice(["_", ""])) for n in NAMES.split("|")]
    paths = ["", "", "", "src/config.py", "web/page", "src3", "tests/fixtures/keys.txt", "docs/example.md"]
    near = lambda: " ".join(rng.choice([word(), made_up()]) for _ in range(rng.randint(2, 5)))
    out = []
    for k in range(rows):
        before, after, path = near() + " ", " " + near(), rng.choice(paths)
        if k % 2:
            value = rng.choice([
                lambda: some(hexa, rng.choice([32, 40, 40, 48, 64])), lambda: some(alnum, rng.randint(20, 64)), lambda: "AKIA" + some(alnum.upper(), 16), lambda: "ghp_" + some(alnum, 36),
                lambda: "sk-" + some(alnum, 48), lambda: "xoxb-" + some("0123456789", 12) + "-" + some(alnum, 24), lambda: some(alnum + "+/", 43) + "=", lambda: "eyJ" + some(alnum + "_-", 80),
            ])()
            q = rng.choice(['"', '"', "'", ""])
            sign = rng.choice([" = ", "=", ": ", ":"])
            name = rng.choice(names)
            style = rng.random()
            name = name.upper() if style < 0.2 else name
            if style < 0.1:
                value = value.upper()
            known = re.match(PREFIXES, value)
            if not known or rng.random() < 0.6:
                before, after = before + name + sign + q, q + after
        else:
            value, lead, tail = rng.choice([
                lambda: (some(hexa, rng.choice([32, 40, 64])), rng.choice(["commit ", "sha1: ", "md5=", "revision ", "checksum: "]), ""),
                lambda: ("-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)), rng.choice(["id ", "uuid: ", "guid=", ""]), ""),
                lambda: ("_".join(word() for _ in range(rng.randint(3, 5))) + "_" + some("0123456789", rng.randint(1, 4)), "", ""),
                lambda: ("-".join(made_up() for _ in range(rng.randint(3, 6))) + "-" + some("0123456789", rng.randint(1, 4)), "https://www.", ".html"),
                lambda: ("/".join([word(), some("0123456789", 4), some("0123456789", 2), made_up()]), "", rng.choice([".png", ".html", ".txt"])),
                lambda: (some("0123456789", rng.randint(16, 20)), "", ""), lambda: ("-".join(some("0123456789", 4) for _ in range(4)), "", ""),
                lambda: (rng.choice(["your_api_key_here_1234", "xxxxxxxxxxxxxxxx0000", "example_token_12345678", "changeme12345678", "0000000000000000000a"]), rng.choice(['token = "', "api_key: ", ""]), ""),
                lambda: (some("abcdef", 3) + "=" * rng.randint(14, 40) + some("0123456789", 2), "", ""), lambda: ("".join(made_up() for _ in range(4)) + some("0123456789", 1), "", ""),
                lambda: (made_up() + made_up(), rng.choice(["password: ", "token = ", "auth: "]), ""),
            ])()
            before, after = before + lead, tail + after
        out.append((value, before[-BEFORE:], after[:AFTER], path, k % 2))
    return out


_TRAINED: dict[str, str] = {}


def _tree_sql(lines: list[str], names: list[str]) -> str:
    """The SQL of a decision tree from the lines of its debug string."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return line.split(":")[1].strip()
    feature, bound = re.fullmatch(r"If \(feature (\d+) <= ([-+.\dE]+)\)", line).groups()
    yes = _tree_sql(lines, names)
    lines.pop(0)
    return f"CASE WHEN {names[int(feature)]} <= {float(bound)!r}D THEN {yes} ELSE {_tree_sql(lines, names)} END"


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> str:
    """The forest as SQL over f.<feature>: the share of trees that take a candidate for a secret."""
    rows = json.dumps(findings if findings is not None else labelled_findings())
    if rows not in _TRAINED:
        as_dicts = json.dumps([dict(zip(("v", "before", "after", "path", "label"), r, strict=True)) for r in json.loads(rows)])
        known = spark.range(1).select(F.explode(F.from_json(F.lit(as_dicts), "array<struct<v string, before string, after string, path string, label int>>")).alias("r")).select("r.*")
        known = known.select(F.col("label").cast("double"), *(F.expr(sql).cast("double").alias(n) for n, sql in FEATURES.items()))
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known).select("label", "features")
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, featureSubsetStrategy="sqrt").fit(ready)
        names = [f"f.{n}" for n in FEATURES]
        trees = [_tree_sql(t.toDebugString.splitlines()[1:], names) for t in model.trees]
        _TRAINED[rows] = "(" + " + ".join(trees) + f") / {len(trees)}"
    return _TRAINED[rows]


def _scored(docs: DataFrame, text_col: str, path_col: str | None, score: str) -> DataFrame:
    """docs with _gaps, the texts between candidates, and _found, the candidates with their scores."""
    taken = docs.withColumns({
        "_found": F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PATTERN), F.lit(0)),
        "_path": F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit(""),
    })
    gaps = F.when(F.size("_found") > 0, F.split(F.col(text_col), PATTERN, -1)).otherwise(F.array(F.col(text_col)))
    taken = taken.withColumn("_gaps", gaps)
    taken = taken.withColumn("_found", F.expr(f"transform(_found, (v, i) -> struct(v, right(_gaps[i], {BEFORE}) AS before, left(_gaps[i + 1], {AFTER}) AS after))"))
    inner = ", ".join(f"cast({sql} AS double) AS {n}" for n, sql in FEATURES.items())
    inner = re.sub(r"\b(v|before|after)\b(?=[ ,)])", r"c.\1", inner).replace("path rlike", "_path rlike")
    taken = taken.withColumn("_found", F.expr(f"transform(_found, c -> struct(c.v AS v, c.before AS before, struct({inner}) AS f))"))
    return taken.withColumn("_found", F.expr(f"transform(_found, c -> struct(c.v AS v, {score.replace('f.', 'c.f.')} AS score))"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings=None) -> DataFrame:
    """(id_col, start, length, value, score, is_secret) of every candidate: its place in characters from 0 and the forest's verdict."""
    score = train(docs.sparkSession, findings)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(path_col).alias("path")] if path_col else []))
    rows = _scored(own, "text", "path" if path_col else None, score).where(F.size("_found") > 0)
    # The characters before candidate k: all gaps up to it and all candidates before it.
    start = "length(array_join(slice(_gaps, 1, k + 1), '')) + length(array_join(transform(slice(_found, 1, k), x -> x.v), ''))"
    rows = rows.select("id", "_gaps", "_found", F.posexplode("_found").alias("k", "c")).withColumn("start", F.expr(start))
    return rows.select(F.col("id").alias(id_col), F.col("start"), F.length("c.v").alias("length"), F.col("c.v").alias("value"), F.col("c.score").alias("score"), (F.col("c.score") >= CUT).alias("is_secret"))


def redact(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", findings=None) -> DataFrame:
    """docs with every secret in the text replaced by MASK; all rows and columns stay, and other texts are untouched."""
    score = train(docs.sparkSession, findings)
    path = {"path": F.col(path_col)} if path_col else {}
    rows = _scored(held(docs, text=F.col(text_col), **path), "text", "path" if path_col else None, score)
    put = f"transform(_gaps, (g, i) -> concat(g, CASE WHEN i >= size(_found) THEN '' WHEN _found[i].score >= {CUT} THEN '{MASK}' ELSE _found[i].v END))"
    clean = F.when(F.exists("_found", lambda c: c["score"] >= CUT), F.expr(f"array_join({put}, '')")).otherwise(F.col("text"))
    return freed(rows, docs.columns, **{text_col: clean})
