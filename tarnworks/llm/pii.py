"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors (at-signs, plus signs, digits, schemes and identifier cues). Around each
anchor a deterministic parser walks to the boundaries of the e-mail address, network address, number or account
and validates it. Nothing is matched that no anchor leads to, so the cost follows the text, not the patterns.
Spans of one kind don't overlap, the leftmost stays. A run of characters that a parser has walked to its end is not
walked again from an anchor within it, so the work on a text grows with its length, whatever it holds.

Null and empty texts have no spans; an empty table gives no rows; repeated rows give repeated rows; other columns are
ignored; a text of any length is searched whole.
"""

from __future__ import annotations

import hashlib

import ahocorasick
from pyspark.sql import DataFrame

from tarnworks.llm.common import over_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")
RANK = {kind: k for k, kind in enumerate(KINDS)}

ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DIGITS = frozenset("0123456789")
LETTER_VALUES = {c: int(c, 36) for c in ALNUM}
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")
VALUE = ALNUM | frozenset("_-./+=")
URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`|{}")
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "compte", "cuenta", "customer id", "passport", "ssn"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api key"),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    for anchor, what in (("@", "email"), ("+", "phone"), ("://", "url")):
        found.add_word(anchor, (what, len(anchor)))
    for what, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (what, len(cue)))
    found.make_automaton()
    return found


def walk(text: str, at: int, allowed: frozenset, end: int) -> int:
    while at < end and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; ``floor``: where the last one ended."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = walk(text, at + 1, LABEL, len(text))
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = walk(text, end + 1, LABEL, len(text))
        dots += 1
    return (start, end) if dots else None


def phone(text: str, at: int) -> tuple[int, int] | None:
    """The number after the plus sign at ``at``: a digit, something between, and the last digit of the run."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = walk(text, at + 2, PHONE, len(text))
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or not 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
        return None
    return at, end


def numbers(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Addresses of four parts and card numbers among the runs of digits."""
    spans, k = [], 0
    while k + 3 < len(runs):
        part = runs[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(part, part[1:])):
            if all(len(p := text[s:e].lstrip("0")) <= 3 and int(p or 0) <= 255 for s, e in part):
                spans.append((part[0][0], part[3][1], "ip"))
            k += 4
        else:
            k += 1
    k = 0
    while k < len(runs):
        last = k
        while last + 1 < len(runs) and runs[last + 1][0] == runs[last][1] + 1 and text[runs[last][1]] in " -":
            last += 1
        count = sum(e - s for s, e in runs[k : last + 1])
        if 12 <= count <= 19 and luhn("".join(text[s:e] for s, e in runs[k : last + 1])):
            spans.append((runs[k][0], runs[last][1], "card"))
        k = last + 1
    return spans


def url(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The address around the scheme's end at ``at``, and where the run of its characters ends."""
    start = at
    while start > 0 and text[start - 1] in SCHEME:
        start -= 1
    if start == at or not text[start].isalpha():
        return None, 0
    run = at + 3
    while run < len(text) and text[run] not in URL_END:
        run += 1
    end = run
    while end > at + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    return ((start, end) if end > at + 3 else None), run


def iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number with its check digits, up to 12 separators after the cue that ends at ``at``."""
    start = at
    while start < min(len(text), at + 12) and text[start] not in ALNUM:
        start += 1
    end, head, rest, count = start, 0, 0, 0  # country and check digits as a number; the others' remainder by 97
    while end < len(text) and count < 34:
        c = text[end]
        if c in ALNUM:
            count += 1
            value = LETTER_VALUES[c]
            if count > 4:
                rest = (rest * (100 if value > 9 else 10) + value) % 97
            elif (count <= 2) == (value > 9):
                head = head * (100 if value > 9 else 10) + value
            else:
                return None
        elif c != " " or end + 1 == len(text) or text[end + 1] not in ALNUM:
            return None
        end += 1
        if count >= 15 and (end == len(text) or text[end] not in ALNUM) and (rest * 1_000_000 + head) % 97 == 1:
            return start, end
    return None


def after_cue(text: str, at: int, between: str, allowed: frozenset, digits: int, least: int) -> tuple[tuple[int, int] | None, int]:
    """What follows the cue that ends at ``at``, and where the run of its characters ends.

    If it is too short or has too few digits, so is what follows any later cue within the run.
    """
    start = at
    while start < min(len(text), at + 12) and text[start] in between:
        start += 1
    if start == at:
        return None, 0
    run = walk(text, start, allowed, len(text))
    end = run
    while end > start and text[end - 1] in ".-/+":
        end -= 1
    value = text[start:end]
    return ((start, end) if len(value) >= least and sum(c in DIGITS for c in value) >= digits else None), run


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text, by start and then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters change their length
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    spans, runs, floor = [], [], 0
    walked = dict.fromkeys(("url", "iban", "account", "secret"), 0)  # up to where each kind has been looked for
    for last, (what, length) in anchors.iter(low):
        start = last + 1 - length
        if what == "digit":
            if runs and last < runs[-1][1]:
                continue
            runs.append((last, walk(text, last, DIGITS, len(text))))
            continue
        if start < walked.get(what, 0):
            continue
        if what == "email":
            got = email(text, last, floor)
            floor = got[1] if got else floor
        elif what == "phone":
            got = phone(text, last)
        elif what == "url":
            got, walked[what] = url(text, start)
        elif what == "iban":
            got = iban(text, last + 1)
            walked[what] = got[1] if got else 0
        elif what == "account":
            got, walked[what] = after_cue(text, last + 1, " :#=.-\t", LABEL, 6, 6)
        else:
            got, walked[what] = after_cue(text, last + 1, " :=\"'\t", VALUE, 1, 8)
        if got:
            spans.append((*got, what))
    spans += numbers(text, runs)
    return sorted(spans, key=lambda s: (s[0], RANK[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of start, end, kind, value), for every row of ``docs``."""

    def run(batches):
        anchors = automaton()
        for batch in batches:
            found = [find(t, anchors) for t in batch[text_col]]
            yield {id_col: batch[id_col], "spans": [[{"start": s, "end": e, "kind": k, "value": t[s:e]} for s, e, k in x] for x, t in zip(found, batch[text_col])]}

    kept = docs.select(id_col, text_col)
    return over_batches(kept, run, f"{id_col} {kept.schema[id_col].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string,value:string>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts by base kind, the hash of the base spans, all spans as text.

    After them come the counts of the further kinds and ``n_personal``, the number of spans other than web addresses.
    """

    def run(batches):
        anchors = automaton()
        for batch in batches:
            found = [find(t, anchors) for t in batch["text"]]
            out = {"doc_id": batch["doc_id"]}
            for kind in BASE:
                out[f"n_{kind}"] = [sum(s[2] == kind for s in x) for x in found]
            out["base_sha256"] = [hashlib.sha256(joined([s for s in x if s[2] in BASE]).encode()).hexdigest() for x in found]
            out["spans"] = [joined(x) for x in found]
            for kind in KINDS[len(BASE) :]:
                out[f"n_{kind}"] = [sum(s[2] == kind for s in x) for x in found]
            out["n_personal"] = [sum(s[2] != "url" for s in x) for x in found]
            yield out

    return over_batches(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_iban long, n_account long, n_secret long, n_personal long")
