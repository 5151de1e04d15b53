"""Personal data in texts: labelers vote on candidate spans, and a classifier learns from their votes. Built-in functions
only, but for the fit on a table of vote patterns whose size is bounded."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import materialize

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Capitalised words in a row, initials among them, from the first that no greeting, title or function word is.
WORD = r"\p{Lu}(?:\p{Ll}++|['\u2019]\p{Lu}\p{Ll}++)(?:-\p{Lu}\p{Ll}++)?+"
PERSON = rf"(?<![\p{{L}}'\u2019-])(?!(?:%s)\b){WORD}(?:\x20(?:\p{{Lu}}\.|{WORD}))++(?!\p{{L}})"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"

#: Kinds in the order of numbers; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "local", "ssn", "person", "account"]

# Gazetteers and cue words.
NAMES = (
    "Adam Alan Albert Alejandro Alex Alexander Alice Amanda Ana Andrea Andrew Angela Anita Ann Anna Anne Anthony Antonio Arthur Barbara Beatriz Ben Benjamin Brian "
    "Bruno Camille Carl Carla Carlos Carmen Caroline Catherine Charles Charlotte Chris Christian Christine Christopher Claire Clara Claudia Cristina Daniel Daniela David "
    "Deborah Diana Diego Dieter Dmitri Donna Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Eva Fernando Fiona Florian Francesca Francis Frank Franz Gabriel "
    "George Giovanni Giulia Grace Gustav Hanna Hans Harry Helen Helga Henri Henry Hugo Ian Ingrid Irene Isabel Ivan Jack Jacob James Jane Janet Jean Jennifer Jessica "
    "Joan John Jonas Jorge Jose Joseph Josephine Juan Julia Julie Karen Karl Kate Katherine Kevin Klaus Laura Lea Leon Linda Lisa Louis Louise Lucas Lucia Luis Luisa "
    "Manuel Marco Margaret Maria Marie Mario Mark Marta Martin Mary Matthew Max Michael Michel Miguel Monica Nancy Natalia Nicolas Nina Olga Oliver Olivia Oscar Pablo "
    "Patricia Patrick Paul Paula Peter Philip Pierre Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Simon Sofia Sophie Stephen Susan Sven Teresa "
    "Thomas Tom Ursula Victor Victoria Walter William Yves"
).split()
SURNAMES = (
    "Adams Anderson Bauer Becker Bernard Brown Campbell Clark Cohen Davies Davis Diaz Dubois Dupont Evans Fernandez Fischer Garcia Gomez Gonzalez Green Gupta Hall Harris "
    "Hernandez Hill Hoffmann Jackson Johnson Jones Kim King Klein Koch Kowalski Lee Lefebvre Lewis Lopez Martin Martinez Meyer Miller Mitchell Moore Moreau Morgan Morris "
    "Mueller Muller Murphy Nelson Nguyen Novak Patel Perez Peters Petit Phillips Richter Roberts Robinson Rodriguez Romero Rossi Roux Ruiz Sanchez Schmidt Schneider "
    "Schulz Scott Silva Simon Singh Smith Taylor Thomas Thompson Torres Turner Wagner Walker Weber White Williams Wilson Wolf Wood Wright Young Zimmermann"
).split()
NO_NAMES = (
    "A After All Also Although An And As At Because Before Both But By Can Contact Could Dear Did Do Does Dr For From Has Have He Hello Her Hi His How However If In Is It Its Last Later Madam Meanwhile "
    "Miss Mr Mrs Ms My Next No Not Now Of On Once Or Our Please Prof Professor She Since Sir So Soon Thank Thanks That The Their Then There These They This To Today Tomorrow Was We Were What When Where "
    "While Who Why Will With Would Yesterday You Your"
).split()
NOT_SURNAMES = "Street Road Avenue Square City County River Lake Island University College School Church Hospital Airport Park Award Prize Day January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Act Bank Bridge Canyon Center Centre Company Council Desert Edition General Hotel House Institute International License Lakes Management Market Ministry Morning Mountain Mountains Museum National North East Ocean Office Palace Public Republic Sea Section Service South States Station Table Tower United Valley Version West".split()
IBAN_COUNTRIES = "AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR UA".split()
ADVERTISED_SSN = ["078051120", "219099999", "457555462"]
DOMAIN_ENDS = "com org net edu gov mil info io co de fr es it nl be at uk eu us ca au jp ch ru br mx in".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 353 358 420".split()
CUES = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|amex|payment|pay",
    "phone": "phone|tel|call|mobile|fax|cell",
    "local": "phone|tel|call|mobile|fax|cell",
    "ssn": "ssn|social|security",
    "person": "mr|mrs|ms|dr|prof|name|named|by|from|dear|contact|attn|patient|employee|signed|regards|sincerely|mother|father|son|daughter|sister|brother|wife|husband|colleague|friend|neighbour|manager",
    "account": "account|iban|acct|customer|client|member|bank|policy|routing",
}
#: What stands right before a name, and what right after one.
BEFORE_NAME = "(mr|mrs|ms|dr|prof|professor|miss|madam|sir|dear|hi|hello|regards|sincerely|signed|name|attn|patient|employee)\\b\\W*$"
AFTER_NAME = "^,?\\x20(said|says|wrote|writes|asked|asks|told|tells|lives|lived|works|worked|joined|signed|replied|phoned|called|was born|is my|has been)\\b"
COUNTER_CUES = "version|isbn|issn|doi|serial|sku|order|page|figure|build"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _is_ip(m: Column) -> Column:
    parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))


def _is_card(m: Column) -> Column:
    return F.length(_digits(m)).between(12, 19) & _luhn(_digits(m))


def _is_iban(m: Column) -> Column:
    """Its check digits are right: the number that it spells, first four characters last, is 1 modulo 97."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    characters = F.filter(F.split(F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4))), ""), lambda c: c != "")
    more = lambda a, c: F.when(c <= "9", (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(characters, F.lit(0), more) == 1


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    if no is not None:
        out = out.when(no, F.lit(-1))
    return out.otherwise(F.lit(0))


def _votes(kind: str, s: Column) -> tuple[Column, Column, Column, Column]:
    """Of the four labelers on a span: pattern, gazetteer, words before it, characters beside it. 1, 0 (no opinion) or -1."""
    m, digits = s["m"], _digits(s["m"])
    true = F.lit(True)
    before = F.lower(s["before"])
    words, coded = F.split(m, "\\x20"), m.rlike("^[A-Z]")
    named = F.element_at(words, 1).isin(NAMES) | F.element_at(words, -1).isin(SURNAMES)
    other = F.arrays_overlap(words, F.array(*map(F.lit, NOT_SURNAMES)))
    length = F.length(digits).between(8, 20)
    pattern, known = {
        "email": lambda: (_vote(m.rlike("^[A-Za-z0-9][^@]*@.*\\.[A-Za-z]{2,}$"), true), _vote(F.lower(F.element_at(F.split(m, "\\."), -1)).isin(DOMAIN_ENDS), F.lower(m).rlike("@(mail[0-9]*\\.)?example\\."))),
        "ip": lambda: (_vote(_is_ip(m), ~_is_ip(m)), _vote(m.rlike("^(10|172|192|8|1)\\."), m.rlike("^(0|127|255)\\."))),
        "card": lambda: (_vote(_is_card(m), ~_is_card(m)), _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"), true)),
        "phone": lambda: (_vote(F.length(digits).between(9, 15), true), _vote(digits.rlike(f"^({'|'.join(COUNTRY_CODES)})"), true)),
        "local": lambda: (_vote(digits.rlike("^[2-9]..[2-9]"), true), _vote(F.lit(False), digits.rlike("^([2-9](00|11)|555)|^([0-9])\\2{9}$"))),
        "ssn": lambda: (_vote(~digits.rlike("^(000|666|9)|^...00|0000$"), true), _vote(F.lit(False), digits.isin(ADVERTISED_SSN))),
        "person": lambda: (
            _vote(before.rlike(BEFORE_NAME) | s["after"].rlike(AFTER_NAME), before.rlike("(^|[^a-z])(in|at|on|near|of|the)\\x20$") | (F.size(F.array_distinct(words)) == 1)),
            _vote(named & ~other, other),
        ),
        "account": lambda: (
            F.when(coded, 1).otherwise(_vote(length & before.rlike("(\\b(no|nr|number|id)\\b|#)[\\s.:]*$"), ~length)),
            _vote(coded & F.left(m, F.lit(2)).isin(IBAN_COUNTRIES), digits.rlike("^(19|20)[0-9]{6}$|^([0-9])\\2+$|^97[89][0-9]{10}$")),
        ),
    }[kind]()
    cue = _vote(before.rlike(f"(?<![a-z])({CUES[kind]})(?![a-z])"), before.rlike(f"(?<![a-z])({COUNTER_CUES})(?![a-z])"))
    glued = s["after"].rlike("^[\\p{L}0-9_]") | s["before"].rlike("[\\p{L}0-9_]$")
    return pattern, known, cue, _vote(F.lit(False), glued)


#: Sizes of the cells that describe a span's shape and context: length, separators in it, what is before and what is after
#: it, and the words on both sides (none, or one of three classes by hash).
CELLS = (4, 3, 3, 3, 4, 4)
WIDTH = math.prod(CELLS)


def _cells(s: Column) -> tuple[Column, ...]:
    """What the classifier sees beside the votes, as small numbers."""
    signs = F.array_size(F.array_distinct(F.filter(F.split(F.regexp_replace(s["m"], "[\\p{L}0-9]", ""), ""), lambda c: c != "")))
    word = lambda x: F.when(x == "", 0).otherwise(1 + F.pmod(F.hash(F.lower(x)), F.lit(3)))
    return (
        F.least(F.lit(3), F.floor((s["end"] - s["start"]) / 8).cast("int")),
        F.least(F.lit(2), signs),
        F.when(s["before"].rlike("(^|\\n)$"), 0).when(s["before"].rlike("[\\p{L}0-9_.-]$"), 1).otherwise(2),
        F.when(s["after"].rlike("^(\\n|$)"), 0).when(s["after"].rlike("^[\\p{L}0-9_-]"), 1).otherwise(2),
        word(F.regexp_extract(s["before"], "(\\p{L}+)[^\\p{L}]*$", 1)),
        word(F.regexp_extract(s["after"], "^[^\\p{L}]*(\\p{L}+)", 1)),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, base_spans and candidates, an array of (start, no, end, kind, pattern).

    Persons are candidates by shape, whatever the names: two to four capitalised words. pattern holds the four votes and the cells of shape and context as one number (``CELLS``). Candidates are the
    matches of the base patterns, checks failed or not, and of looser ones. One pass, without a shuffle.
    """
    person = PERSON % "|".join(NO_NAMES)
    finders = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "local": LOCAL, "ssn": SSN, "person": person, "iban": IBAN}
    stage = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    has = {"email": F.instr("t", "@") > 0, "phone": F.instr("t", "+") > 0}
    some = lambda k: S.matches(F.col("t"), finders[k])
    none = F.expr("cast(array() as array<string>)")
    stage = stage.withColumn("m", F.struct(*(F.when(has[k], some(k)).otherwise(none).alias(k) if k in has else some(k).alias(k) for k in finders)))
    # A match of one digit more or less can't be a card or an account; most numbers in a text are short.
    located = {k: S.located(F.col("t"), finders[k], F.col(f"m.{k}")) for k in finders}
    located["card"] = F.filter(located["card"], lambda s: F.length(_digits(s["m"])) >= 8)
    located["person"] = F.filter(located["person"], lambda s: F.regexp_count(s["m"], F.lit(" ")) <= 3)
    stage = stage.select("doc_id", F.struct(*(located[k].alias(k) for k in finders)).alias("s"))
    card = F.filter("s.card", lambda s: _is_card(s["m"]))
    account = F.filter("s.card", lambda s: ~_is_card(s["m"]))
    valid = {
        "email": F.col("s.email"),
        "ip": F.filter("s.ip", lambda s: _is_ip(s["m"])),
        "card": card,
        "phone": F.filter("s.phone", lambda s: F.length(_digits(s["m"])).between(9, 15)),
    }
    every = {k: F.col(f"s.{k}") for k in finders} | {"card": card, "account": F.concat(account, F.filter("s.iban", lambda s: _is_iban(s["m"])))}

    def described(kind: str) -> Column:
        def one(s: Column) -> Column:
            code = F.lit(0)
            for v in _votes(kind, s):
                code = code * 3 + (v + 1)
            for n, cell in zip(CELLS, _cells(s), strict=True):
                code = code * n + cell
            return F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), code.alias("pattern")
            )

        return F.transform(every[kind], one)

    base = S.joined(*(S.labelled(valid[k], i, k) for i, k in enumerate(KINDS[:4])))
    return stage.select("doc_id", base.alias("base_spans"), F.array_sort(F.concat(*(described(k) for k in KINDS))).alias("candidates"))


@dataclass
class Model:
    """reliability[kind][labeler][class][vote + 1] (1 for no opinion) and prior[kind] from EM; weights of the logistic span classifier."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray


def _decode(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (n x 4) and cells (n x 6) of codes."""
    code, cells = pattern // WIDTH, []
    rest = pattern % WIDTH
    for n in reversed(CELLS):
        cells.append(rest % n)
        rest = rest // n
    return np.stack([code // 27 % 3, code // 9 % 3, code // 3 % 3, code % 3], axis=1) - 1, np.stack(cells[::-1], axis=1)


def _blocks() -> list[tuple[int, int]]:
    """First column and size of each block of features: the kind, each labeler's vote and each cell by kind."""
    sizes = [len(KINDS), *[3 * len(KINDS)] * 4, *(len(KINDS) * n for n in CELLS)]
    return list(zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True))


def _columns(no: np.ndarray, votes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Of each row the columns that are 1, one of each block."""
    each = [no, *(no * 3 + v + 1 for v in votes.T), *(no * n + c for n, c in zip(CELLS, cells.T, strict=True))]
    return np.stack([first + x for (first, _), x in zip(_blocks(), each, strict=True)], axis=1)


def fit(found: DataFrame, rounds: int = 60) -> Model:
    """Reliabilities by expectation-maximisation over the counts of votes, then a logistic classifier of the posteriors.

    The classifier sees the votes, and by kind the shape and the context of a span, so it differs from the posterior where
    spans of equal votes lie in unlike places. Counts come from all candidates. The driver gets a row for each kind and
    pattern that occurs, 8 * 81 * WIDTH (1.1 million) at most, whatever the input.
    """
    rows = (
        found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.no").alias("no"), F.col("c.pattern").alias("pattern")).count().collect()
    )
    no, pattern, n = (np.array([r[i] for r in rows], int) for i in range(3))
    width = sum(size for _, size in _blocks())
    reliability, prior, w = np.ones((len(KINDS), 4, 2, 3)), np.full(len(KINDS), 0.5), np.zeros(width)
    if not len(rows):
        return Model(reliability, prior, w)
    votes, cells = _decode(pattern)
    truth = np.clip(0.4 + 0.35 * votes.sum(axis=1), 0.1, 0.9)  # start: a soft majority; no votes tell rather no
    before = np.array([[4.0, 0.0, 1.0], [1.0, 0.0, 4.0]])  # counts beforehand: labelers are right more often than not
    for _ in range(rounds):
        for c, p in enumerate((1 - truth, truth)):
            for j in range(4):
                seen = np.bincount(no * 3 + votes[:, j] + 1, weights=p * n, minlength=3 * len(KINDS)).reshape(-1, 3) + before[c]
                seen[:, 1] = 0  # a labeler without an opinion tells nothing
                reliability[:, j, c] = seen / seen.sum(axis=1, keepdims=True)
                reliability[:, j, c, 1] = 1
        prior = (np.bincount(no, weights=truth * n, minlength=len(KINDS)) + 1) / (np.bincount(no, weights=n, minlength=len(KINDS)) + 2)
        log = [np.log(q) + sum(np.log(reliability[no, j, c, votes[:, j] + 1]) for j in range(4)) for c, q in enumerate((1 - prior[no], prior[no]))]
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    ones, share = _columns(no, votes, cells), n / n.sum()
    for _ in range(40):  # Newton steps, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(w[ones].sum(axis=1), -30, 30)))
        h, g = 1e-4 * np.eye(width), -1e-4 * w
        for j in range(ones.shape[1]):
            g += np.bincount(ones[:, j], weights=share * (truth - p), minlength=width)
            for k in range(ones.shape[1]):
                h += np.bincount(ones[:, j] * width + ones[:, k], weights=share * p * (1 - p), minlength=width * width).reshape(width, width)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(reliability, prior, w)


def probability(model: Model, c: Column) -> Column:
    """The classifier's probability of a candidate, as arithmetic on its kind and pattern."""
    tables = [F.array(*map(F.lit, model.weights[first : first + size].tolist())) for first, size in _blocks()]
    code, rest = F.floor(c["pattern"] / WIDTH).cast("int"), F.pmod(c["pattern"], F.lit(WIDTH))
    each = [c["no"], *(c["no"] * 3 + F.pmod(F.floor(code / k).cast("int"), F.lit(3)) for k in (27, 9, 3, 1))]
    power = WIDTH
    for n in CELLS:
        power //= n
        each.append(c["no"] * n + F.pmod(F.floor(rest / power).cast("int"), F.lit(n)))
    return 1 / (1 + F.exp(-sum((F.get(t, i) for t, i in zip(tables, each, strict=True)), F.lit(0.0))))


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, base_spans and pii_spans, arrays of (start, no, end, kind), a row for each row.

    base_spans are the matches of the four base patterns that pass their checks. pii_spans also hold the candidates
    which the classifier finds likelier than ``threshold``, for which a labeler votes, and which overlap no base span;
    candidates of several kinds on one place are each kept. Offsets are code points, ends exclusive. A null or empty text has none; no rows give no rows.
    """
    found = materialize(candidates(docs), "pii")
    model = fit(found)
    likely = F.filter(
        "candidates",
        lambda c: (probability(model, c) > threshold)
        & reduce(lambda a, k: a | (F.pmod(F.floor(c["pattern"] / (WIDTH * k)).cast("int"), F.lit(3)) == 2), (27, 9, 3, 1), F.lit(False))
        & ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    more = F.transform(likely, lambda c: F.struct(c["start"].alias("start"), c["no"].alias("no"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.select("doc_id", "base_spans", S.joined(F.col("base_spans"), more).alias("pii_spans"))
