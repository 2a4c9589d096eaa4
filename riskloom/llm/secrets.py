"""Secret scanning with a random forest that removes false positives (DataFrame functions only).

Candidates are found by patterns: blocks of private keys, values assigned to a name such as ``password`` or
``token``, known forms of keys, and long runs of letters and digits. A random forest then scores each candidate on its length, the
make-up of its characters and the transitions between them, how much of it a dictionary covers, the path it
comes from and the words next to it. The forest and the transitions are learned from labelled findings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
_KEY_HEADER = r"-----BEGIN (?:[A-Z0-9]+ ){0,6}PRIVATE KEY-----"
#: A key from its header to its end mark: header fields, and lines of base64. Cut ones end with their last full line.
_KEY = _KEY_HEADER + r"(?:\s++[A-Z][A-Za-z-]*+: [^\r\n]*+){0,8}(?:(?:\s|\\n)*+[A-Za-z0-9+/=]{16,}+){0,400}(?:(?:\s|\\n){0,4}[A-Za-z0-9+/=]{0,15}(?:\s|\\n){0,4}-----END (?:[A-Z0-9]+ ){0,6}PRIVATE KEY-----)?"
_ASSIGNED = rf"(?i:{_NAMES}s?[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)[^\s\"'<>]{{6,}}"
_RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
#: Forms of keys that need no digit, and so no look for one.
_KNOWN = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-|sk_live_|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}"
_KNOWN_RUN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{{16}})(?:{_KNOWN})[A-Za-z0-9+/_=-]*"
#: A candidate; no groups, so that splitting by it leaves the text between candidates.
CANDIDATE = f"{_KEY}|{_ASSIGNED}|{_KNOWN_RUN}|{_RUN}"
#: Characters on either side of a candidate whose words are looked at.
CONTEXT = 48

#: Words of placeholders, identifiers and prose, for the dictionary coverage; a parameter of the features.
DICTIONARY = tuple(
    """about access account action address admin and api app area array auto bar baz before begin block build button call change changeme chapter client code
    color comment commit common config content custom data date default delete demo description detail digest document domain dummy edit email enable
    end entry error event example external false file filter find first foo for format function general guest hash head help hidden home host html
    http icon image index info input insert install invalid item key label level library line link list load local login main message method model
    module month name net network new next node none note null number object open option order org other output page password path place placeholder
    please post private product project public query record release replace report reset result root sample save search secret section select send
    server service set short show site size source start state status string sub switch system table tag task temp test text that the this time title
    todo token tool total true type unknown update upper url user value version view web work write www year you your""".split()
)
#: The words beside a candidate that speak for a secret, and against one.
_SECRET_WORDS = r"(?i)\b(?:password|passwd|pwd|secret|token|api.?key|access.?key|credentials?|auth|bearer)\b"
_HARMLESS_WORDS = r"(?i)\b(?:sha-?\d*|md5|checksum|digest|hash|commit|revision|uuid|guid|etag|example|sample|dummy|placeholder|version|integrity|isbn|order|invoice)\b"
_HARMLESS_PATH = r"(?i)\b(?:tests?|examples?|samples?|fixtures?|mocks?|docs?|specs?|vendor)\b"
_FEATURES = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_symbols", "f_distinct", "f_switches", "f_transitions", "f_spoken", "f_runs", "f_hex", "f_uuid",
    "f_covered", "f_assigned", "f_known", "f_path", "f_secret_words", "f_harmless_words",
)
#: Kinds of characters for transitions: letters without case, digits as one, all others as one more.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
_KINDS = len(_ALPHABET) + 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, path, start (1-based, in characters), matched, value, before, after.

    Each row gets its own edges of the text around it, and nothing of its neighbours; starts are summed in runs of 256, so a
    text full of candidates costs little more than in proportion.
    """
    some = docs.where(F.col(text_col).rlike(CANDIDATE)).select(
        F.col(id_col).alias("doc_id"),
        F.col(path_col).cast("string").alias("path"),
        F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)).alias("m"),
        F.split(text_col, CANDIDATE, -1).alias("gaps"),
    )
    run = 256

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def found(v: Column) -> Column:
        m, gaps = v["m"], v["gaps"]
        # what lies between the starts of a match and the one before
        advances = F.transform(m, lambda x, i: (F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(F.lit(0))).cast("long"))

        def with_advances(adv: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / run).cast("int")), lambda k: total(F.slice(adv, k * run + 1, F.lit(run))))
            begins = F.aggregate(runs, F.array(F.lit(1).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

            def with_begins(b: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    k = F.floor(i / run).cast("int")
                    start = F.get(b, k) + total(F.slice(adv, k * run + 1, i - k * run + 1))
                    return F.struct(start.alias("start"), x.alias("matched"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))

                return F.transform(m, one)

            return _let(begins, with_begins)

        return _let(advances, with_advances)

    rows = some.select("doc_id", "path", F.explode(_let(F.struct("m", "gaps"), found)).alias("c")).select("doc_id", "path", "c.*")
    assigned = F.col("matched").rlike(r"(?s)^(?i:" + _NAMES + r"s?[\"']?)\s{0,3}[=:]")
    value = F.when(assigned, F.regexp_extract("matched", r"""(?s)^[^=:]*[=:]\s{0,3}["']?(.*)$""", 1)).otherwise(F.col("matched"))
    return rows.select("doc_id", "path", "start", "matched", value.alias("value"), "before", "after")


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _pairs(value: Column) -> Column:
    """Of each pair of neighbouring characters its number, from 0."""
    plain = F.translate(F.lower(value), "123456789", "000000000")
    code = lambda text, at: F.instr(F.lit(_ALPHABET), F.substr(text, at, F.lit(1)))
    return F.when(F.length(plain) > 1, _let(plain, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: code(t, i) * _KINDS + code(t, i + 1)))).otherwise(F.array().cast("array<int>"))


def with_features(findings: DataFrame, transitions: tuple[float, ...] | None = None, dictionary: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """Add the forest's features to rows of matched, value, before, after and path. ``transitions`` has the log-odds of each pair
    of characters in secrets; without it they count as even."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    around = F.concat_ws(" ", "before", F.expr("left(matched, length(matched) - length(value))"), "after")
    letters = F.greatest(_count(v, "[A-Za-z]"), F.lit(1.0))
    covered = F.length(v) - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), ""))
    odds = F.lit(0.0)
    if transitions:
        table = F.array(*[F.lit(float(x)) for x in transitions])
        odds = F.aggregate(_pairs(v), F.lit(0.0), lambda acc, k: acc + F.element_at(table, k + 1)) / n
    own = {
        "f_length": F.log2(n),
        "f_digits": _count(v, "[0-9]") / n,
        "f_upper": _count(v, "[A-Z]") / n,
        "f_lower": _count(v, "[a-z]") / n,
        "f_symbols": _count(v, "[^A-Za-z0-9]") / n,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "f_switches": _count(v, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / n,
        "f_transitions": odds,
        # consonant-vowel transitions are what spoken words are made of
        "f_spoken": _count(F.lower(v), "[bcdfghjklmnpqrstvwxyz](?=[aeiou])") / letters,
        "f_runs": _count(v, r"(.)(?=\1\1)") / n,
        "f_hex": v.rlike("^[0-9a-f]+$").cast("double"),
        "f_uuid": v.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$").cast("double"),
        "f_covered": covered / n,
        "f_assigned": (F.length("matched") > F.length("value")).cast("double"),
        "f_known": F.col("matched").rlike(rf"^(?:{_KEY_HEADER}|{_KNOWN})").cast("double"),
        "f_path": F.coalesce(F.col("path").rlike(_HARMLESS_PATH), F.lit(False)).cast("double"),
        "f_secret_words": around.rlike(_SECRET_WORDS).cast("double"),
        "f_harmless_words": around.rlike(_HARMLESS_WORDS).cast("double"),
    }
    return findings.withColumns(own)


#: What surrounds generated findings, one tuple for each family; a family shares no name, context or path with another.
_FAMILIES = (
    {
        "keys": ("password=", 'token = "', "secret: ", "api_key="),
        "plain": ("see the page", "part of", "then comes", "the value is"),
        "hash": ("sha256 checksum of the file", "commit", "md5 of the image", "etag"),
        "fake": ("your-secret-here-", "changeme", "example-token-", "xxxxxxxxxxxx", "value-of-key-", "not_a_secret_"),
        "paths": ("src/app", "lib/core", "tests/fixtures/data", "docs/page"),
        "known": ("AKIA", "ghp_"),
    },
    {
        "keys": ("pwd=", 'access_key: "', "passphrase=", "credential: "),
        "plain": ("as said in", "written by", "number", "it began with"),
        "hash": ("revision", "digest of the layer", "integrity", "uuid of the disk"),
        "fake": ("placeholder-value-", "dummy_default_", "sample-password-", "insert-key-here-", "${CONFIG_VALUE}-", "********"),
        "paths": ("service/main", "cmd/server", "examples/demo", "vendor/pkg"),
        "known": ("ASIA", "gho_"),
    },
    {
        "keys": ("passwd: ", "secrets=", "private-key=", 'tokens: "'),
        "plain": ("found in", "below", "as of", "next to it"),
        "hash": ("guid", "checksum", "the sha-1 is", "commit hash"),
        "fake": ("replace-me-", "todo-set-this-", "default-secret-", "test_password_", "{{template.name}}-", "<........>"),
        "paths": ("pkg/auth", "internal/db", "samples/first", "mocks/all"),
        "known": ("AKIA2", "ghs_"),
    },
)


def labelled_findings(spark: SparkSession, rows: int = 6000, families: tuple[int, ...] = tuple(range(len(_FAMILIES)))) -> DataFrame:
    """Generated findings of fourteen kinds with label 1 (secret) or 0, each from the hash of its number: id, family, kind,
    matched, value, before, after, path, label.

    They stand in for an audit's labelled findings, which the tables at hand lack; any table of the last six columns
    can take their place. Families differ in all names, contexts and paths, and a test of one that was not trained on is a
    held-out test. Paths are drawn without regard to the label.
    """
    number = F.concat(F.lit("finding "), F.col("id").cast("string"))
    h, g = F.sha2(number, 256), F.sha2(F.concat(number, F.lit(" more")), 256)

    def digit(at: int, n: int) -> Column:
        """A number below n from two hex digits of the second hash."""
        return F.conv(F.substring(g, at, 2), 16, 10).cast("int") % n

    mixed = F.translate(F.concat(F.base64(F.unhex(h)), F.base64(F.unhex(g))), "+/=", "Zk7")
    upper = F.upper(F.translate(F.base64(F.unhex(g)), "+/=", "Q7X"))
    syllables = ("ther", "ing", "on", "en", "ation", "er", "com", "pro", "al", "es", "to", "re", "ment", "in", "de", "la")
    syllable = lambda at: F.element_at(F.array(*[F.lit(x) for x in syllables]), digit(at, 16) + 1)
    word = F.concat(syllable(1), syllable(3), syllable(5))
    other = F.concat(syllable(7), syllable(9))
    own = F.element_at(F.array(*[F.lit(k) for k in families]), digit(61, len(families)) + 1)

    def pick(name: str, at: int) -> Column:
        lists = [F.element_at(F.array(*[F.lit(x) for x in f[name]]), digit(at, len(f[name])) + 1) for f in _FAMILIES]
        return reduce(lambda out, k: F.when(own == k, lists[k]).otherwise(out), range(1, len(lists)), lists[0])

    key, plain, none = pick("keys", 11), pick("plain", 13), F.lit("")
    size = 12 + digit(15, 29)
    digits = F.conv(F.substring(h, 9, 4), 16, 10)
    known = pick("known", 17)
    symbols = F.translate(F.left(mixed, F.lit(10) + digit(19, 8)), "AbCd", "#!$%")
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n"), F.reverse(mixed), F.lit("\n-----END RSA PRIVATE KEY-----"))
    # value, name in front of it, words before it, label
    kinds = [
        (F.concat(known, F.when(known.rlike("^A"), F.left(upper, 20 - F.length(known))).otherwise(F.left(mixed, F.lit(36)))), F.when(digit(21, 2) == 0, key).otherwise(none), plain, 1),
        (F.left(h, F.element_at(F.array(*[F.lit(x) for x in (32, 40, 64)]), digit(21, 3) + 1)), key, plain, 1),
        (F.left(mixed, size), key, plain, 1),
        (F.left(h, size), key, plain, 1),
        (symbols, key, plain, 1),
        (block, none, plain, 1),
        (F.left(mixed, size + 8), key, none, 1),
        (F.left(h, F.element_at(F.array(*[F.lit(x) for x in (32, 40, 64)]), digit(21, 3) + 1)), none, pick("hash", 23), 0),
        (F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), none, plain, 0),
        (F.concat(pick("fake", 25), digits), key, plain, 0),
        (F.concat(word, F.lit("_"), digits, F.lit("_"), other, word), none, plain, 0),
        (F.concat(F.lit("/"), word, F.lit("/"), digits, F.lit("/"), other), none, plain, 0),
        (F.concat(word, F.element_at(F.array(F.lit(""), F.lit("-"), F.lit("_")), digit(27, 3) + 1), other), key, plain, 0),
        (F.concat(F.upper(other), F.lit("-20"), F.left(digits, F.lit(2)), F.lit("-"), digits, F.lit("-A")), none, plain, 0),
    ]
    kind = (F.col("id") % len(kinds)).cast("int")
    choose = lambda options: F.element_at(F.array(*options), F.col("kind") + 1)
    base = spark.range(0, rows, 1, 4).withColumns({"kind": kind, "family": own.cast("int")})
    out = base.select(
        "id",
        "family",
        "kind",
        choose([v for v, *_ in kinds]).alias("value"),
        choose([k for _, k, *_ in kinds]).alias("__key"),
        F.concat_ws(" ", other, choose([b for *_, b, _ in kinds]), none).alias("before"),
        F.concat_ws(" ", none, word).alias("after"),
        pick("paths", 29).alias("path"),
        choose([F.lit(float(y)) for *_, y in kinds]).alias("label"),
    )
    return out.withColumn("matched", F.concat("__key", "value")).drop("__key")


@dataclass(frozen=True)
class SecretModel:
    """The forest, the log-odds of character pairs (one number each, fixed in number), and the dictionary of its features."""

    forest: RandomForestClassificationModel
    transitions: tuple[float, ...]
    dictionary: tuple[str, ...]

    def vectors(self, findings: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(with_features(findings, self.transitions, self.dictionary))

    def scored(self, findings: DataFrame) -> DataFrame:
        """``findings`` with their features and score, the forest's share for a secret."""
        out = self.forest.transform(self.vectors(findings))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def learn_transitions(labelled: DataFrame) -> tuple[float, ...]:
    """Of each pair of neighbouring characters the log-odds of standing in a secret; at most 2 * 28 * 28 counts are fetched."""
    rows = labelled.select((F.col("label") > 0).alias("secret"), F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n"))
    counts = {True: [1.0] * _KINDS**2, False: [1.0] * _KINDS**2}
    for r in rows.collect():
        counts[r["secret"]][r["pair"]] += r["n"]
    totals = {k: sum(v) for k, v in counts.items()}
    return tuple(math.log(a / totals[True]) - math.log(b / totals[False]) for a, b in zip(counts[True], counts[False], strict=True))


def train(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7, dictionary: tuple[str, ...] = DICTIONARY) -> SecretModel:
    """Learn from findings (matched, value, before, after, path, label)."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    transitions = learn_transitions(labelled)
    untrained = SecretModel(None, transitions, dictionary)
    return SecretModel(forest.fit(untrained.vectors(labelled).select("features", "label")), transitions, dictionary)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start, length, kind, fingerprint, score and is_secret.

    The value itself isn't returned, only its SHA-256 (of a private key, that of the whole block). Candidates below ``threshold``
    are false positives and stay in the result with is_secret false; a score of exactly the threshold is a secret. Null and empty texts have no candidates; a null
    path counts as harmless to nothing; long texts are scanned whole; repeated rows are reported each; extra columns are
    ignored, and an empty table gives an empty result. Candidates don't overlap: of several at one place the first pattern counts.
    """
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    found = model.scored(candidates(docs, id_col, text_col, path_col))
    kind = F.when(F.col("matched").rlike(f"^{_KEY_HEADER}"), "private_key").when(F.length("matched") > F.length("value"), "assigned").otherwise("run")
    return found.select("doc_id", "start", F.length("matched").alias("length"), kind.alias("kind"), F.sha2("value", 256).alias("fingerprint"), "score", (F.col("score") >= threshold).alias("is_secret"))
