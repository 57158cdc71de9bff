r"""Personal data by weak supervision.

Candidate spans come from patterns. The four base kinds (email, ip, card, phone) always stay; for
the further kinds (secret, ssn, iban) three labelers vote yes, no or abstain on each candidate, each
by evidence of its own: a regex on the span's characters, a gazetteer of words that name such data
(or its lookalikes) near it, and its context, the signs that join it to the text. Candidates for
secrets are long unbroken tokens, and whatever is assigned to a word of the gazetteer.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
without any labels, and the resulting posteriors train the final span classifier, a naive Bayes
model over votes, length and alphabet. Spans that it gives MIN_SCORE or more are added.

Labelers see BEFORE code points before a span and AFTER behind it: a parameter of theirs, not of the
search, which runs over whole texts.

Patterns run once over each text; the spans go to the shared folder. What comes to the driver are
counts of (kind, votes, features), at most 7 * 27 * 4 * 4 rows whatever the input; the classifier
returns as a literal list of accepted combinations.

Patterns use possessive loops and look-behinds, so neither the stack nor the time grows beyond the
text's length times its longest token; they match exactly what the plain ones would. Places of n
matches are summed up in blocks of the square root of n, as an array grows by copying.

Defined cases: a null text is empty and has no spans; rows that repeat get equal results; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, table

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE = 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Runs of 14 digits or more only: shorter ones fail anyway, and a run is always matched whole.
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # What is assigned to a word of the gazetteer, or a long token anywhere.
    "secret": r"(?i:(?<=[=:]\s{0,2}[\"'`]?)(?<=\b(?:SECRET_WORDS)\s{0,2}[=:]\s{0,2}[\"'`]?)[^\s\"'`<>,;=:]{4,}+)|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Gazetteers of words that name such data, in the languages of the corpus, and of words that name its lookalikes.
SECRET_WORDS = (
    "access_key", "api", "api_key", "apikey", "auth", "authorization", "bearer", "clave", "clave_secreta", "client_secret", "contraseña", "credential", "credentials", "geheimnis", "jeton", "kennwort", "key", "mot_de_passe", "passcode", "passphrase", "passwd", "password",
    "passwort", "pin", "private_key", "pwd", "schlüssel", "secret", "secret_key", "secreto", "signature", "token", "zugangscode",
)
SSN_WORDS = ("insurance", "nss", "número de seguridad", "security", "seguridad", "sicherheit", "social", "sozialversicherung", "ssn", "sécurité", "versicherung", "versicherungsnummer")
IBAN_WORDS = ("account", "bank", "banque", "banco", "bic", "compte", "cuenta", "iban", "konto", "kontonummer", "swift", "transfer", "überweisung", "virement")
LOOKALIKES = ("blob", "checksum", "chapter", "commit", "digest", "file", "hash", "href", "http", "https", "id", "isbn", "issn", "md5", "part", "path", "revision", "sha1", "src", "url", "uuid", "version", "www")
PATTERNS["secret"] = PATTERNS["secret"].replace("SECRET_WORDS", "|".join(SECRET_WORDS))
#: A cheap test that a text can hold the kind at all.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9+/_-]{20}|[=:]", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
BEFORE, AFTER = 80, 20
MIN_SCORE = 0.5
YES, NO, ABSTAIN = 1, 0, 2

SPAN = "struct<start:int,kind:int,stop:int,text:string>"


def find(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with code-point places: the pieces between matches, split by the same pattern, give the gaps."""
    none = F.array().cast(f"array<{SPAN}>")
    step = lambda acc, x: F.struct(
        (acc["pos"] + x["gap"] + F.length(x["s"])).alias("pos"),
        F.array_append(acc["out"], F.struct((acc["pos"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (acc["pos"] + x["gap"] + F.length(x["s"])).alias("stop"), x["s"].alias("text"))).cast(f"array<{SPAN}>").alias("out"),
    )

    def in_block(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

    def in_blocks(blocks: Column) -> Column:
        """Each block from where the ones before it end."""
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["s"]))))
        return F.flatten(F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(blocks)), in_block))

    def places(m: Column) -> Column:
        pieces = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(m))
        pairs = F.zip_with(pieces, m, lambda g, s: F.struct(F.length(g).alias("gap"), s.alias("s")))
        side = F.ceil(F.sqrt(F.size(m))).cast("int")
        blocks = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.size(m) / side).cast("int") - 1), lambda b: F.slice(p, b * side + 1, side)))
        return F.when(F.size(m) == 0, none).otherwise(let(blocks, in_blocks))

    return F.when(text.rlike(GUARDS[kind]), let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), places)).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def iban_checks(s: Column) -> Column:
    """Whether the number that an IBAN stands for leaves 1 when divided by 97."""
    t = F.regexp_replace(s, "\\x20", "")
    moved = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)) == 1


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAIN)


def _named(words) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"


def votes(text: Column, span: Column) -> Column:
    """struct(kind, v1, v2, v3, f1, f2): the three labelers' votes and the classifier's further features."""
    s = span["text"]
    is_ = lambda kind: span["kind"] == KINDS.index(kind)
    hexed = s.rlike("^[0-9a-fA-F]{32,}$") | (s.rlike("[0-9]") & s.rlike("[A-Z]") & s.rlike("[a-z]") & (F.length(s) >= 24)) | (s.rlike("[0-9]") & s.rlike(r"\p{L}") & s.rlike(r"[^\p{L}0-9/_-]"))
    shape = F.when(is_("secret"), _vote(hexed, ~s.rlike("[0-9]"))).when(is_("ssn"), _vote(~s.rlike("^(?:000|666|9)") & ~s.rlike("-00-|-0000$"), s.rlike("^(?:000|666|9)"))).otherwise(_vote(iban_checks(s), ~iban_checks(s)))

    def by(near: Column) -> Column:
        before, after = near["before"], near["after"]
        names = F.when(is_("secret"), before.rlike(_named(SECRET_WORDS))).when(is_("ssn"), before.rlike(_named(SSN_WORDS))).otherwise(before.rlike(_named(IBAN_WORDS)))
        named = _vote(names, before.rlike(_named(LOOKALIKES)))
        held = _vote(before.rlike(r"[=:]\s*[\"'`]?$") | (before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")), before.rlike(r"[/#?&._]$|[\p{L}\p{N},.]\s$") | after.rlike(r"^[/?&#]"))
        size = F.when(F.length(s) < 24, 0).when(F.length(s) < 40, 1).when(F.length(s) < 80, 2).otherwise(3)
        letters = F.when(s.rlike("^[0-9-]+$"), 0).when(s.rlike("^[0-9a-fA-F]+$"), 1).when(s.rlike("[0-9]"), 2).otherwise(3)
        return F.struct(span["kind"].alias("kind"), shape.alias("v1"), named.alias("v2"), held.alias("v3"), size.alias("f1"), letters.alias("f2"))

    from_ = F.greatest(span["start"] - BEFORE, F.lit(0))
    near = F.struct(F.substring(text, from_ + 1, span["start"] - from_).alias("before"), F.substring(text, span["stop"] + 1, F.lit(AFTER)).alias("after"))
    return let(near, by)


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: array of (start, kind, stop, key); key is null for base spans, else what the classifier sees."""
    t = F.coalesce(F.col("text"), F.lit(""))
    only = lambda kind: F.filter(find(F.col("t"), kind), lambda x: valid(kind, x["text"]))
    valid_ones = [only(k) for k in KINDS]
    key = lambda x: F.when(x["kind"] >= BASE, votes(F.col("t"), x))
    all_spans = F.transform(F.flatten(F.array(*valid_ones)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), key(x).alias("key")))
    return docs.select("doc_id", t.alias("t")).select("doc_id", all_spans.alias("spans"))


NAMES = ("v1", "v2", "v3")


def posterior(c: dict, prior: float, rate: dict) -> float:
    odds = math.log(prior) - math.log(1 - prior) + sum(math.log(rate[v][1][c[v]]) - math.log(rate[v][0][c[v]]) for v in NAMES)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def reliabilities(own: list[dict], rounds: int = 50) -> tuple[float, dict]:
    """(the share of true candidates, each labeler's P(vote | class)) of one kind, from counts of vote patterns alone, by Dawid-Skene expectation-maximisation."""
    prior = 0.5
    # A labeler that votes is right in 4 of 5 cases at first, and abstains alike in both classes.
    rate = {v: {1: {YES: 0.56, NO: 0.14, ABSTAIN: 0.3}, 0: {YES: 0.14, NO: 0.56, ABSTAIN: 0.3}} for v in NAMES}
    total = sum(c["n"] for c in own)
    for _ in range(rounds):
        post = [posterior(c, prior, rate) for c in own]
        prior = min(0.99, max(0.01, (1 + sum(p * c["n"] for p, c in zip(post, own, strict=True))) / (2 + total)))
        for v in NAMES:
            for y in (1, 0):
                got = {x: 1.0 for x in (YES, NO, ABSTAIN)}
                for p, c in zip(post, own, strict=True):
                    got[c[v]] += c["n"] * (p if y else 1 - p)
                rate[v][y] = {x: g / sum(got.values()) for x, g in got.items()}
    return prior, rate


def fit(counts: list[dict]) -> dict[tuple, float]:
    """Scores of (kind, v1, v2, v3, f1, f2) from their counts: the labelers' reliabilities, then naive Bayes from the posteriors that they give."""
    scores: dict[tuple, float] = {}
    features = (*NAMES, "f1", "f2")
    for kind in sorted({c["kind"] for c in counts}):
        own = [c for c in counts if c["kind"] == kind]
        prior, rate = reliabilities(own)
        mass: dict = {1: 1.0, 0: 1.0}
        seen: dict = defaultdict(lambda: 1.0)
        for c in own:
            p = posterior(c, prior, rate)
            for y, w in ((1, p), (0, 1 - p)):
                mass[y] += w * c["n"]
                for f in features:
                    seen[y, f, c[f]] += w * c["n"]
        for c in own:
            odds = math.log(mass[1]) - math.log(mass[0]) + sum(math.log(seen[1, f, c[f]] / (mass[1] + 4)) - math.log(seen[0, f, c[f]] / (mass[0] + 4)) for f in features)
            scores[tuple(c[k] for k in ("kind", *features))] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return scores


def accepted(found: DataFrame) -> tuple[list[str], dict[tuple, float]]:
    """The keys that the classifier accepts, fitted on all candidates."""
    keys = found.select(F.explode("spans").alias("s")).where("s.key is not null").groupBy("s.key").agg(F.count(F.lit(1)).alias("n"))
    counts = [r["key"].asDict() | {"n": r["n"]} for r in keys.collect()]
    scores = fit(counts)
    return sorted("|".join(map(str, k)) for k, s in scores.items() if s >= MIN_SCORE), scores


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: array of (start, kind, stop), by start and then kind."""
    found = materialize(candidates(docs))
    keep, _ = accepted(found)
    name = lambda k: F.concat_ws("|", *[k[c].cast("string") for c in ("kind", "v1", "v2", "v3", "f1", "f2")])
    stays = lambda x: x["key"].isNull() | F.array_contains(F.array(*[F.lit(k) for k in keep]).cast("array<string>"), name(x["key"]))
    spans = F.transform(F.filter("spans", stays), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    return found.select("doc_id", F.sort_array(spans).alias("spans"))


def op3_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    n = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return find_personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.size("spans").cast("long").alias("n_spans"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
