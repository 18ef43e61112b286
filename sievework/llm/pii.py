"""Personal data in texts by anchor expansion.

Method: an Aho-Corasick automaton finds anchors in one pass over each text: at-signs, plus signs, URL schemes, identifier
cues and digits. Deterministic local parsers expand each anchor to the boundaries of an e-mail address, a phone number, a
network address, a card number, a link with a user in it or an account, and validate it. Nothing else of the text is looked at.

Kinds of the base: email, ip, card, phone. The method adds: link (a scheme with user information, or mailto: and tel:) and
account (an IBAN with right check digits, or the number after a cue).

Results: null or empty texts have no spans; repeated rows get equal results; an empty table gives an empty one. Extra columns
are ignored. Places are code points; spans of one kind never overlap.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "link", "account")
#: Words that announce an identifier.
CUES = ("iban", "account", "acct", "passport", "ssn", "customer id", "konto", "compte", "cuenta")

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = set("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER = re.compile(r"[A-Za-z0-9._~%+:-]+@[A-Za-z0-9.-]+[A-Za-z0-9](?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[\x20\t]*(?:no\.?|number|nr\.?)?[\x20\t]*[:#=]?[\x20\t]*((?=[A-Z-]*[0-9])[A-Z0-9][A-Z0-9-]{5,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """One automaton for all anchors, and the parsers behind it."""

    def __init__(self) -> None:
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for word, kind in [("@", "email"), ("+", "phone"), ("://", "link"), ("mailto:", "link"), ("tel:", "link"), *((d, "digit") for d in "0123456789"), *((c, "cue") for c in CUES)]:
            self.anchors.add_word(word, (kind, len(word)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in order of start, then of kind."""
        lower = text.encode().lower().decode()  # A-Z only, so places stay
        out: list[tuple[int, int, str]] = []
        done = dict.fromkeys(KINDS, 0)

        def put(kind: str, start: int, end: int) -> None:
            out.append((start, end, kind))
            done[kind] = end

        for last, (kind, size) in self.anchors.iter(lower):
            at = last - size + 1
            if kind == "digit":
                # the digits of a run are one anchor: matches start at a run's start or where one ended inside it
                if at >= done["ip"] and (at == done["ip"] or at == 0 or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append((at, m.end(), "ip"))
                if at >= done["card"] and (m := _CARD.match(text, at)):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
            elif kind == "email":
                start = at
                while start > done["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    put("email", start, m.end())
            elif kind == "phone":
                if at >= done["phone"] and (m := _PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        out.append((at, m.end(), "phone"))
            elif kind == "link":
                self._link(text, at, last + 1, put, done)
            elif at >= done["account"] and not (at and lower[at - 1].isalnum()) and not lower[last + 1 : last + 2].isalnum():
                self._account(text, last + 1, put)
        out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return out

    @staticmethod
    def _link(text: str, at: int, after: int, put, done: dict) -> None:
        if text[at] == ":":
            start = at
            while start > done["link"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := _USER.match(text, after)):
                put("link", start, m.end())
        elif at >= done["link"]:
            m = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z0-9]").match(text, after) if text[at] in "mM" else re.compile(r"\+?[0-9][0-9().-]{5,}[0-9]").match(text, after)
            if m:
                put("link", at, m.end())

    @staticmethod
    def _account(text: str, after: int, put) -> None:
        start = after
        while start < len(text) and text[start] in " :#=":
            start += 1
        if m := _IBAN.match(text, start):
            for end in range(m.end(), start + 14, -1):  # the longest part with right check digits
                value = text[start:end].replace(" ", "")
                if text[end - 1] != " " and len(value) >= 15 and iban(value):
                    put("account", start, end)
                    return
        if m := _NUMBER.match(text, after):
            put("account", m.start(1), m.end(1))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans (`kind:start:end`, comma-joined) of every row."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches):
        finder = Finder()
        for b in batches:
            counts, digests, joined = {k: [] for k in BASE}, [], []
            for text in b.column("_text"):
                spans = finder.spans(text.as_py())
                base = [s for s in spans if s[2] in BASE]
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                joined.append(_listed(spans))
            columns = [b.column("_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = f"id {id_type}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string"
    return source.mapInArrow(common.tidy(run), schema).withColumnRenamed("id", id_col)


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; overlapping spans take the first's kind."""
    place = docs.columns.index(text_col)

    def run(batches):
        finder = Finder()
        for b in batches:
            out = []
            for value in b.column(place):
                text = value.as_py()
                parts, at = [], 0
                for start, end, kind in finder.spans(text) if text else []:
                    if start >= at:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                    at = max(at, end)
                out.append(text if text is None or not parts else "".join([*parts, text[at:]]))
            arrays = [pa.array(out, pa.string()) if i == place else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    done = common.settled(docs.mapInArrow(common.tidy(run), docs.schema), "redacted")
    return done.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)) if length_col and length_col in docs.columns else done
