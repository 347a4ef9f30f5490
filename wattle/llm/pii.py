"""Personal data in texts: regular expressions propose spans, checksum
validators (Luhn, mod 97) confirm them, and nearby context words adjust the
score. Kinds whose shape alone proves little are added only above a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from wattle.llm.textkit import ship_package, with_carried

# Every pattern is read once from left to right: possessive runs, and a start
# only where a run starts, so that a very long run of one class stays linear.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

# Characters on either side of a span in which context words count.
NEAR = 48
# What an added kind must reach.
LEAST_SCORE = 0.5


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right doubled, nines cast out."""
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 7064 as account numbers use it: first four characters
    to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with a local part before it (not reaching into the match
    before) and a host of at least two labels behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def spans_of(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest beginning of a proposal that ends with a group and whose
    check digits are right: what follows may be a word in capitals."""
    for m in _IBAN.finditer(text):
        found, ends = m.group(), {m.end()}
        ends |= {m.start() + i for i, c in enumerate(found) if c == " "}
        for end in sorted(ends, reverse=True):
            code = text[m.start():end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code) and not text[end:end + 1].isalnum():
                yield m.start(), end
                break


def is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(found: str) -> bool:
    digits = digits_of(found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_date(found: str) -> bool:
    _, month, day = found.split("-")
    return 1 <= int(month) <= 12 and 1 <= int(day) <= 31


@dataclass(frozen=True)
class Kind:
    """``prior``: score of a confirmed span without context; words near it
    raise (``words``) or lower (``against``) it by ``weight``."""

    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    prior: float
    words: frozenset[str]
    against: frozenset[str] = frozenset()
    weight: float = 0.3


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_NUMBERED = words("order invoice ref reference isbn article item serial version bestellung commande pedido")
BASE = (
    Kind("email", emails, lambda s: True, 0.8,
         words("mail email e contact write address correo courriel kontakt schreiben")),
    Kind("ip", spans_of(_IP), is_ip, 0.6, words("ip host server address login client adresse direccion"),
         words("version release build section chapter")),
    Kind("card", spans_of(_CARD), is_card, 0.7,
         words("card visa mastercard amex credit debit payment paid karte kreditkarte carte tarjeta"), _NUMBERED),
    Kind("phone", spans_of(_PHONE), lambda s: 9 <= len(digits_of(s)) <= 15, 0.7,
         words("call phone tel telephone mobile fax cell whatsapp anrufen telefon telefono llame appelez"), _NUMBERED),
)
MORE = (
    Kind("iban", ibans, lambda s: True, 0.8, words("iban bic account bank konto compte cuenta transfer"), _NUMBERED),
    Kind("ssn", spans_of(_SSN), is_ssn, 0.3, words("ssn social security insurance taxpayer"), _NUMBERED),
    Kind("birthdate", spans_of(_DATE), is_date, 0.3,
         words("born birth birthday dob birthdate geboren geburtsdatum nacido nacida nee naissance"),
         words("released published updated version")),
)
KINDS = BASE + MORE


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """Score of a confirmed span by the words within NEAR characters of it."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start])}
    near |= {w.lower() for w in _WORD.findall(text[end:end + NEAR])}
    shift = kind.weight * (bool(near & kind.words) - bool(near & kind.against))
    return round(min(1.0, max(0.0, kind.prior + shift)), 3)


def personal_spans(text: str | None, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points,
    end exclusive. A proposal that fails its check uses up its text. Kinds of
    BASE stay whatever their score; others need LEAST_SCORE."""
    out = []
    for kind in kinds:
        for start, end in kind.propose(text or ""):
            if kind.confirm(text[start:end]):
                points = score(kind, text, start, end)
                if kind in BASE or points >= LEAST_SCORE:
                    out.append((kind.name, start, end, points))
    return out


def span_text(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def masked(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every span as [KIND]; spans that overlap become one mark,
    that of the span that starts first (the longer one of two)."""
    if not spans:
        return text
    out, done, reach = [], 0, 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= reach:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = reach = max(reach, end)
    return "".join(out) + text[done:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_BASE_NAMES = tuple(k.name for k in BASE)
SCHEMA = ("doc_id long, " + ", ".join(f"n_{n} long" for n in _BASE_NAMES)
          + ", base_sha256 string, spans string, n_added long, "
          "found array<struct<kind:string,start:long,end:long,score:double>>")


def find_personal_data(docs: DataFrame, carry: tuple[str, ...] = (), mask: bool = False) -> DataFrame:
    """One row for each input row: doc_id, the counts of the base kinds,
    base_sha256 (base spans as kind:start:end), ``spans`` (all of them), n_added,
    ``found`` (the spans with scores), with ``mask`` also ``masked`` (the text
    with marks in place of the spans), and, if named in ``carry``, the struct
    ``carried`` of those columns.

    One pass over the texts without a shuffle. A null text is empty and has no
    spans (``masked`` stays null); a null doc_id stays null; rows that repeat
    give a row each; an empty table gives none. Other columns are ignored,
    whatever their names.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [personal_spans(t) for t in texts]
            base = [[s for s in f if s[0] in _BASE_NAMES] for f in found]
            out = {"doc_id": batch.column(0).cast(pa.int64())}
            for name in _BASE_NAMES:
                out[f"n_{name}"] = pa.array([sum(s[0] == name for s in f) for f in base], pa.int64())
            digests = [hashlib.sha256(span_text(f).encode()).hexdigest() for f in base]
            out["base_sha256"] = pa.array(digests, pa.string())
            out["spans"] = pa.array([span_text(f) for f in found], pa.string())
            out["n_added"] = pa.array([len(f) - len(b) for f, b in zip(found, base, strict=True)], pa.int64())
            names = ("kind", "start", "end", "score")
            out["found"] = pa.array([[dict(zip(names, s, strict=True)) for s in f] for f in found], pa.list_(_SPAN))
            if mask:
                out["masked"] = pa.array([masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
            for i, c in enumerate(carry):
                out[f"carry_{c}"] = batch.column(2 + i)
            yield pa.RecordBatch.from_pydict(out)

    kept = [docs.schema[c] for c in carry]
    schema = SCHEMA + (", masked string" if mask else "") + "".join(f", `carry_{f.name}` {f.dataType.simpleString()}" for f in kept)
    return with_carried(docs.select("doc_id", "text", *carry).mapInArrow(run, schema), carry)
