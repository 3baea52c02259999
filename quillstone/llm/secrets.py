"""Secret scans: a random forest removes false positives, in DataFrame operations only.

Candidates are runs of at least ``LEAST`` key characters that hold a digit or
begin like a known kind of key, wherever they stand: a token with a dot, an @
or other letters beside such a run holds a candidate, or several.  Beside those
are values of any characters, of ``SHORTEST`` to ``LONGEST``, that a text assigns to
a word that announces a secret (``password: ...``), with a digit or without.
Each is described by its length, the transitions between character classes and
between letters, the share that dictionary words cover, the path it was found
under and the words beside it.  The forest is trained on labelled findings and
becomes one SQL expression, so scoring is a projection: nothing is shuffled
and no row leaves the JVM.

The dictionary is a parameter, a list of words that becomes one pattern; the
registered query takes the first ``DICTIONARY_WORDS`` whole words of a public
tokenizer's vocabulary.  The corpus has no labelled findings, so
:func:`labelled_findings` makes them from stated kinds: keys, tokens and
passwords on one side; card, phone and serial numbers, checksums, identifiers,
addresses, long words, placeholders and remarks about passwords on the other.
Callers with findings of their own pass them instead.

Edge cases: null and empty texts have no findings; very long texts are scanned
whole; a token that stands twice is two findings; a candidate whose probability
equals the threshold is a secret; null ids are kept, repeated rows are scanned
each; a path column that is null or absent counts as a plain path; columns made
on the way take names that the table does not have; an empty table gives no
rows.
"""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
_KEY = r"[A-Za-z0-9_+/\-]"
#: How keys of known kinds begin; such a candidate needs no digit.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xoxa-", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")
_HOLDS = rf"(?={'|'.join(PREFIXES)}|[A-Za-z_+/\-]*+[0-9])"
CANDIDATE = rf"(?<!{_KEY}){_HOLDS}{_KEY}{{{LEAST},}}+"
#: Lengths of assigned values, and the pattern that finds them: the word, what stands between, the value.
SHORTEST, LONGEST = 6, 64
ASSIGNED = rf"(?i)(?<![A-Za-z])(?=[psta])(password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth)((?:[\"']?\s?[:=]\s?|[\"']?\s?=>\s?)[\"']?)([^\s\"'<>,;]{{{SHORTEST},{LONGEST}}})"
#: The last run of key characters in what stands before a candidate in its token.
LAST = rf"({_KEY}+)[^A-Za-z0-9_+/\-]*$"
#: What stands between tokens: blanks, quotes, brackets and signs that are in no key.
APART = r"""[^A-Za-z0-9_+/\-.@\x80-\x{10FFFF}]+"""
MASK = "[SECRET]"

#: Words that announce a secret, and words that announce other long strings.
ANNOUNCES = ("token", "secret", "password", "passwd", "pwd", "apikey", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access")
DENIES = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "version", "phone", "tel", "card", "order", "invoice", "serial", "isbn", "build", "revision", "part")
#: Short common words and word parts, the dictionary where none is given.
WORDS = ("the", "and", "for", "that", "with", "this", "from", "have", "not", "are", "was", "ing", "tion", "ment", "able", "ness", "ter", "ver", "con", "pro", "com", "per", "ent", "est", "ion", "der", "die", "das", "und", "ein", "sch", "lich", "keit", "ung", "que", "les", "des", "una", "los", "ado", "mente", "aux", "eau", "elle", "version", "release", "file", "page", "index", "image", "data", "test", "user", "name", "text", "document", "section", "chapter", "item", "order", "number", "report", "model", "build", "config", "default", "example", "sample")
#: Words that are taken from a vocabulary, of four letters or more.
DICTIONARY_WORDS = 3000
#: What stands for a secret that is not told.
PLACEHOLDERS = ("required", "none", "null", "true", "false", "changeme", "example", "redacted", "hidden", "optional", "string", "unknown", "forgotten", "incorrect", "protected", "expired")
#: Frequent letter pairs of running text.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ra", "ce", "li", "ch", "ll", "ma", "si", "om", "ur")
FEATURES = ("length", "digits", "capitals", "transitions", "pairs", "variety", "coverage", "hexadecimal", "numeric", "slashes", "dashes", "announced", "denied", "in_test", "prefixed", "signs", "assigned")

TREES = 25
DEPTH = 8
SEED = 11


def trie_pattern(words: Sequence[str]) -> str:
    """One pattern for a list of words, the longest first, in which words with a common beginning share it."""
    trie: dict = {}
    for w in words:
        at = trie
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def of(node: dict) -> str:
        parts = [re.escape(ch) + of(node[ch]) for ch in sorted(node) if ch]
        if not parts:
            return ""
        inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{inner})?" if "" in node else inner

    return of(trie)


def vocabulary_words(path: str, most: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The first whole words of four letters or more in a vocabulary file with word ends; one without any is an error."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    ranked = sorted(model["vocab"], key=model["vocab"].get)
    words = tuple(islice((w for t in ranked if t.endswith(end) and re.fullmatch("[a-z]{4,}", w := t[: len(t) - len(end)])), most))
    if not words:
        raise ValueError(f"no words in the vocabulary {path}")
    return words


def features(token: Column, before: Column, two_before: Column, after: Column, path: Column, assigned: Column, words: str) -> list[Column]:
    """The :data:`FEATURES` of a candidate, as doubles; ``words`` is the pattern of the dictionary."""
    n = F.greatest(F.length(token), F.lit(1))
    count = lambda pattern: F.length(F.regexp_replace(token, pattern, ""))
    near = [F.lower(F.coalesce(x, F.lit(""))) for x in (before, two_before)]
    says = lambda words: (near[0].rlike(rf"(^|[_\-.])({'|'.join(words)})$") | near[1].rlike(rf"(^|[_\-.])({'|'.join(words)})$"))
    flag = lambda c: c.cast("double")
    lower = F.lower(token)
    return [
        n.cast("double"),
        count("[^0-9]") / n,
        count("[^A-Z]") / n,
        F.regexp_count(token, F.lit("(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[0-9])(?=[A-Za-z])")) / n,
        F.regexp_count(lower, F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / n,
        F.size(F.array_distinct(F.split(token, ""))) / n,
        1 - F.length(F.regexp_replace(lower, words, "")) / n,
        flag(token.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        flag(token.rlike(r"^[0-9+\-]+$")),
        count("[^/]") / n,
        count("[^-]") / n,
        flag(says(ANNOUNCES)),
        flag(says(DENIES) | F.lower(F.coalesce(after, F.lit(""))).isin(*DENIES)),
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike("test|example|sample|fixture|docs?/")),
        flag(token.rlike(f"^({'|'.join(PREFIXES)})")),
        count(r"[A-Za-z0-9_+/\-]") / n,
        flag(assigned),
    ]


@dataclass(frozen=True)
class Finding:
    """A labelled candidate: its text, the words before and after, the path, how it was found, and whether it is a secret."""

    token: str
    before: str
    two_before: str
    after: str
    path: str
    assigned: bool
    secret: bool
    kind: str = ""


def labelled_findings(n: int = 2400, seed: int = SEED, without: Sequence[str] = (), only: Sequence[str] = ()) -> list[Finding]:
    """Findings made from stated kinds, as many secrets as others; ``without`` and ``only`` choose kinds by name."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, upper, alnum = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    word = lambda: "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
    long_word = lambda: word() + word()
    prose = lambda: (word(), word(), word())
    said = lambda words: (rng.choice(words), word(), word())
    either = lambda: rng.choice((prose, lambda: said(ANNOUNCES)))()
    assigned = lambda: (rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key")), "", "")
    # each of these secrets begins with its prefix; the digit makes them candidates where the prefix does not
    secret = {
        "long_hex": lambda: (pick(hexa, rng.choice((32, 40, 48, 64))), *said(ANNOUNCES), False),
        "short_hex": lambda: (pick(hexa, rng.choice((16, 18, 20, 24))), *said(ANNOUNCES), False),
        "access_id": lambda: ("AKIA" + pick(upper, 16), *either(), False),
        "access_letters": lambda: ("AKIA" + pick(string.ascii_uppercase, 16), *either(), False),
        "prefixed": lambda: (rng.choice(("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "AIza")) + pick(alnum, rng.randint(24, 40)), *either(), False),
        "mixed_long": lambda: (pick(alnum + "+/", rng.randint(24, 64)), *either(), False),
        "mixed": lambda: (pick(alnum, rng.randint(16, 40)), *said(ANNOUNCES), False),
        "web_token": lambda: ("eyJ" + pick(alnum + "_-", rng.randint(20, 90)), *either(), False),
        "password_signs": lambda: (pick(alnum + "!#$%&*+?@^_~", rng.randint(8, 20)) + rng.choice("!#$%&*?@"), *assigned(), True),
        "password_word": lambda: (word().title() + pick(string.digits, rng.randint(2, 5)) + rng.choice(("", "!", "#", "$")), *assigned(), True),
        "password_letters": lambda: (pick(string.ascii_letters, rng.randint(9, 20)), *assigned(), True),
        "password_mixed": lambda: (pick(alnum, rng.randint(8, 15)), *assigned(), True),
    }
    other = {
        "card": lambda: (pick(string.digits, rng.choice((16, 17, 18, 19, 20))), *prose(), False),
        "card_said": lambda: (pick(string.digits, 16), *said(DENIES), False),
        "checksum": lambda: (pick(hexa, rng.choice((32, 40, 64))), *said(DENIES), False),
        "uuid": lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), *rng.choice((prose, lambda: said(DENIES)))(), False),
        "slug": lambda: (f"{word()}-{word()}-{word()}-{rng.randint(0, 9999)}", *prose(), False),
        "address": lambda: (f"{word()}/{word()}/{word()}{rng.randint(0, 99)}/{word()}", *prose(), False),
        "name": lambda: (f"{word()}_{word()}{rng.randint(0, 999)}_{word()}", *prose(), False),
        "long_word": lambda: (f"{long_word()}{word()}{rng.randint(0, 99)}", *prose(), False),
        "day": lambda: (f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-{rng.randint(0, 9999):04}", *prose(), False),
        "serial": lambda: (word().upper() + "-" + pick(string.digits, rng.randint(10, 16)), *said(DENIES), False),
        "zeros": lambda: ("0" * rng.randint(16, 40), *prose(), False),
        "filler": lambda: (rng.choice("x0aA1") * rng.randint(15, 40) + "1", *said(ANNOUNCES), False),
        "placeholder": lambda: (rng.choice((str.lower, str.upper, str.title))(rng.choice(PLACEHOLDERS)), *assigned(), True),
        "stars": lambda: (rng.choice("*x.-#") * rng.randint(6, 16), *assigned(), True),
        "remark": lambda: (long_word() + rng.choice(("", ".", ")", "!")), *assigned(), True),
        "variable": lambda: (rng.choice(("${", "{{", "$", "%")) + long_word() + rng.choice(("}", "}}", "", "%")), *assigned(), True),
        "call": lambda: (f"{word()}.{word()}(" + rng.choice((")", word() + ")")), *assigned(), True),
    }
    chosen = [{k: f for k, f in kinds.items() if k not in without and (not only or k in only)} for kinds in (other, secret)]
    sides = [(bool(y), kinds) for y, kinds in enumerate(chosen) if kinds]
    rows = []
    for i in range(n):
        y, kinds = sides[i % len(sides)]
        kind = rng.choice(list(kinds))
        token, before, two_before, after, is_assigned = kinds[kind]()
        path = rng.choice(("src", "app/main", "web", "src0") if y else ("src", "app/main", "web", "src0", "docs/guide", "tests/unit"))
        if not is_assigned:
            if not token.startswith(PREFIXES) and not any(c.isdigit() for c in token):
                token += "7"
            token += "0" * (LEAST - len(token))
        else:
            token = (token + "x" * (SHORTEST - len(token)))[:LONGEST]
        rows.append(Finding(token, before, two_before, after, path, is_assigned, y, kind))
    return rows


@dataclass
class Node:
    """A leaf has ``p``; another node sends rows with feature <= cut to ``low``."""

    p: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: list[tuple[list[float], int]], rng: random.Random, depth: int = DEPTH) -> Node:
    """A tree by Gini impurity over random feature subsets."""
    ones = sum(y for _, y in rows)
    node = Node(ones / len(rows))
    if not depth or ones in (0, len(rows)) or len(rows) < 4:
        return node
    width = len(rows[0][0])
    best = (1e-9, -1, 0.0)
    whole = node.p * (1 - node.p) * len(rows)
    for f in rng.sample(range(width), max(1, round(width**0.5) + 1)):
        ordered = sorted((x[f], y) for x, y in rows)
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][1]
            if ordered[i][0] > ordered[i - 1][0]:
                a, b = left / i, (ones - left) / (len(rows) - i)
                gain = whole - a * (1 - a) * i - b * (1 - b) * (len(rows) - i)
                if gain > best[0]:
                    best = (gain, f, (ordered[i][0] + ordered[i - 1][0]) / 2)
    if best[1] < 0:
        return node
    low = [r for r in rows if r[0][best[1]] <= best[2]]
    high = [r for r in rows if r[0][best[1]] > best[2]]
    return Node(node.p, best[1], best[2], grow(low, rng, depth - 1), grow(high, rng, depth - 1))


def forest(rows: list[tuple[list[float], int]], trees: int = TREES, seed: int = SEED) -> list[Node]:
    rng = random.Random(seed)
    return [grow([rng.choice(rows) for _ in rows], rng) for _ in range(trees)]


def probability(trees: list[Node], x: Column) -> Column:
    """The forest as an expression over an array of features."""

    def of(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(float(node.p))
        return F.when(F.get(x, F.lit(node.feature)) <= F.lit(node.cut), of(node.low)).otherwise(of(node.high))

    total = of(trees[0])
    for t in trees[1:]:
        total = total + of(t)
    return total / F.lit(float(len(trees)))


@dataclass(frozen=True)
class Model:
    """The trees, and the pattern of the dictionary that their features were made with."""

    trees: list[Node]
    words: str


def train(spark: SparkSession, findings: Sequence[Finding] | None = None, dictionary: Sequence[str] = WORDS) -> Model:
    """A forest from labelled findings; their features are made by the expressions that scans use."""
    words = trie_pattern(dictionary)
    rows = json.dumps([asdict(r) for r in (findings if findings is not None else labelled_findings())])
    kind = "array<struct<token:string,before:string,two_before:string,after:string,path:string,assigned:boolean,secret:boolean>>"
    df = spark.range(1).select(F.explode(F.from_json(F.lit(rows), kind)).alias("r")).select("r.*")
    made = df.select(F.array(*features(*(F.col(c) for c in ("token", "before", "two_before", "after", "path", "assigned")), words)).alias("x"), "secret").collect()
    return Model(forest([(list(r.x), int(r.secret)) for r in made]), words)


_CANDIDATES = "array<struct<t:string,whole:string,lead:string,b:string,bb:string,a:string,assigned:boolean>>"


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def candidates(text: Column) -> Column:
    """All candidates of a text: the token, what holds it and what leads to it there, and the words beside it."""
    trimmed = lambda t: F.regexp_replace(t, r"^[.@]+|[.@]+$", "")
    word = lambda tokens, i: trimmed(F.coalesce(F.get(tokens, i), F.lit("")))

    def beside(tokens: Column) -> Column:
        """The tokens that hold a candidate, with their neighbours."""
        placed = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(CANDIDATE), i)), lambda i: i.isNotNull())
        return F.transform(placed, lambda i: F.struct(word(tokens, i).alias("t"), word(tokens, i - 1).alias("b"), word(tokens, i - 2).alias("bb"), word(tokens, i + 1).alias("a")))

    # in an array of one, so that the text is split once however often the tokens are named
    held = F.when(text.rlike(CANDIDATE), F.get(F.transform(F.array(F.split(text, APART)), beside), F.lit(0)))
    runs = F.flatten(F.transform(held, lambda z: F.transform(F.regexp_extract_all(z.t, F.lit(CANDIDATE), F.lit(0)), lambda c: F.struct(c.alias("t"), F.regexp_extract(F.left(z.t, F.position(c, z.t) - 1), LAST, 1).alias("own"), z.b.alias("b"), z.bb.alias("bb"), z.a.alias("a")))))
    # what a token holds before the candidate is the word beside it
    found = F.transform(runs, lambda z: F.struct(z.t.alias("t"), z.t.alias("whole"), F.lit("").alias("lead"), F.when(z.own == "", z.b).otherwise(z.own).alias("b"), F.when(z.own == "", z.bb).otherwise(z.b).alias("bb"), z.a.alias("a"), F.lit(False).alias("assigned")))
    # the word, what stands between and the value, again from what matched; values with a run are candidates already
    may = F.exists(F.array(F.lower(text)), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in ("passw", "passphrase", "pwd", "secret", "token", "key", "auth")]))
    wholes = F.when(may, F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(0)))
    part = lambda w, g: F.regexp_extract(w, ASSIGNED, g)
    values = F.transform(wholes, lambda w: F.struct(part(w, 3).alias("t"), w.alias("whole"), F.concat(part(w, 1), part(w, 2)).alias("lead"), part(w, 1).alias("b"), F.lit("").alias("bb"), F.lit("").alias("a"), F.lit(True).alias("assigned")))
    values = F.filter(values, lambda v: ~v.t.rlike(CANDIDATE))
    none = F.array().cast(_CANDIDATES)
    return F.concat(F.coalesce(found.cast(_CANDIDATES), none), F.coalesce(values.cast(_CANDIDATES), none))


def _scored(docs: DataFrame, model: Model, name: str, path_col: str | None = "source") -> DataFrame:
    """The input with the findings of its ``text`` as column ``name``."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    scored = lambda z: F.struct(z.t.alias("token"), z.b.alias("before"), z.a.alias("after"), z.whole.alias("whole"), z.lead.alias("lead"), F.array(*features(z.t, z.b, z.bb, z.a, path, z.assigned, model.words)).alias("x"))
    (held,) = _fresh(docs.withColumn(name, F.lit(0)), name + "_x")
    df = docs.withColumn(held, F.transform(candidates(F.coalesce(F.col("text"), F.lit(""))), scored))
    return df.withColumn(name, F.transform(held, lambda f: F.struct(f.token.alias("token"), f.before.alias("before"), f.after.alias("after"), f.whole.alias("whole"), f.lead.alias("lead"), probability(model.trees, f.x).alias("p")))).drop(held)


def scan(docs: DataFrame, model: Model, path_col: str | None = "source") -> DataFrame:
    """doc_id and ``findings``: token, words beside it and probability of every candidate; assigned values come after the others."""
    (name,) = _fresh(docs, "found")
    return _scored(docs, model, name, path_col).select("doc_id", F.transform(name, lambda f: F.struct(f.token.alias("token"), f.before.alias("before"), f.after.alias("after"), f.p.alias("p"))).alias("findings"))


def secrets_of(findings: str = "findings", threshold: float = 0.5) -> Column:
    return F.filter(findings, lambda f: f.p >= threshold)


def redact(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents with every secret in ``text`` masked; ``n_chars``, where present, counts the new text.

    An assigned value is masked where it is assigned; other places of what may
    be a common word stay.
    """
    name, ordered, masked = _fresh(docs, "found", "ordered", "masked")
    out = _scored(docs, model, name)
    held = F.array_distinct(F.transform(secrets_of(name, threshold), lambda f: F.struct(F.length(f.whole).alias("n"), f.whole.alias("whole"), F.concat(f.lead, F.lit(MASK)).alias("put"))))
    # the longest first, so that no secret is masked inside another
    out = out.withColumn(ordered, F.reverse(F.array_sort(held)))
    some = F.size(ordered) > 0
    out = out.withColumn(masked, F.when(some, F.aggregate(ordered, F.col("text"), lambda text, s: F.replace(text, s.whole, s.put))).otherwise(F.col("text")))
    columns = [F.col(masked).alias("text") if c == "text" else F.when(some, F.length(masked).cast(kind)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return out.select(*columns)
