"""Ways in which personal data is written apart, so that the fixed rules miss it.

``undone`` decides exactly whether a piece of text is personal data of a kind once written-out or
damaged separators are undone; ``windows_to_learn`` rewrites spans of a document in such ways, with
fresh names and digits, between passages and look-alikes that are none.
"""

from __future__ import annotations

import re

import numpy as np

# Words for the at sign and the dot in languages of the documents.
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punto", "point", "punkt")

_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_WORD = r"(?<![^\W_])(?:{})(?![^\W_])"
_BRACKETED = r"[\[({{]\x20?(?:{})\x20?[\])}}]"
AT = re.compile(rf"\x20?(?:{_BRACKETED.format(_AT + '|@')}|{_WORD.format(_AT)}|@)\x20?", re.I)
# A plain dot may have a space on both sides or on none, so that the end of a sentence is no separator.
DOT = re.compile(rf"\x20?(?:{_BRACKETED.format(_DOT + '|[.]')}|{_WORD.format(_DOT)})\x20?|\x20[.]\x20|[.]", re.I)
#: Each way of writing a span holds one of these: a digit, an at sign, a word for a dot, a bracketed sign or an at before a name with a dot.
TRIGGER = re.compile(rf"[0-9@]|{_BRACKETED.format(_AT + '|' + _DOT + '|[.]')}|{_WORD.format(_DOT)}|{_WORD.format(_AT)}(?=\x20?[A-Za-z0-9-]+(?:[.]|\x20[.]\x20)[A-Za-z])", re.I)

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_CARD = re.compile(r"[0-9](?:[\x20._/-]{0,3}[0-9])+")
_PHONE = re.compile(r"(?:\+|plus\x20|\(|\[)?[0-9](?:[\x20().\[\]/-]{0,3}[0-9])+", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def undone(kind: int, s: str) -> bool:
    """Whether ``s`` is an email (0), ip (1), card (2) or phone (3) once its separators are undone; the kind's own tests hold."""
    if kind == 0:
        return len(AT.findall(s)) == 1 and bool(_EMAIL.fullmatch(DOT.sub(".", AT.sub("@", s))))
    if kind == 1:
        plain = DOT.sub(".", s)
        return bool(_IP.fullmatch(plain)) and all(int(p) <= 255 for p in plain.split("."))
    n = len(digits_of(s))
    if kind == 2:
        return 12 <= n <= 19 and bool(_CARD.fullmatch(s)) and luhn(digits_of(s))
    return 9 <= n <= 15 and bool(_PHONE.fullmatch(s)) and n < len(s) and s.count("(") == s.count(")") and s.count("[") == s.count("]")


def holds(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a span of a text is ``undone`` personal data and no part of a longer word or number."""
    a, b, kind = span
    return not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum() and undone(kind, text[a:b])


# --- Training windows ------------------------------------------------------------------------------

_WORDS = re.compile(r"[A-Za-z]{2,12}")
_ENDINGS = ("com", "org", "net", "de", "fr", "es")


def _pick(rng: np.random.Generator, options):
    return options[int(rng.integers(len(options)))]


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def fresh(kind: int, s: str, words: list[str], rng: np.random.Generator) -> str:
    """A span like ``s`` with other names and digits."""
    if kind == 0:
        local, domain = s.rsplit("@", 1)
        labels = domain.split(".")
        if rng.random() < 0.5:
            local = _pick(rng, words).lower() + _pick(rng, ("", ".", "_", "-")) + _pick(rng, (_pick(rng, words).lower(), _number(rng, 2), ""))
            local = local.strip("._-") or "a"
        if rng.random() < 0.5:
            labels = [_pick(rng, words).lower() + _pick(rng, ("", _number(rng, 1))), _pick(rng, _ENDINGS)]
        return local + "@" + ".".join(labels)
    if kind == 1:
        return ".".join(str(p) for p in rng.integers(0, 256, 4))
    out = "".join(_number(rng, 1) if "0" <= c <= "9" else c for c in s)
    if kind == 2:
        body = out[:-1]
        return next(body + str(d) for d in range(10) if luhn(digits_of(body) + str(d)))
    return out


def apart(kind: int, s: str, rng: np.random.Generator) -> str:
    """The rule-conforming span ``s`` written so that the rules miss it."""
    if kind == 0:
        word = _pick(rng, AT_WORDS)
        at = _pick(rng, (f" {word} ", f" ({word}) ", f" [{word}] ", f"[{word}]", f"({word})", " @ ", f" {word.upper()} ", "[@]"))
        local, domain = s.rsplit("@", 1)
        dot = _pick(rng, (".", ".", " . ", f" {_pick(rng, DOT_WORDS)} ", f" ({_pick(rng, DOT_WORDS)}) ", f"[{_pick(rng, DOT_WORDS)}]", "[.]", " DOT "))
        return local + at + dot.join(domain.split("."))
    if kind == 1:
        return _pick(rng, (" . ", "[.]", "(.)", f" {_pick(rng, DOT_WORDS)} ", f" ({_pick(rng, DOT_WORDS)}) ", f"[{_pick(rng, DOT_WORDS)}]")).join(s.split("."))
    d = digits_of(s)
    if kind == 2:
        return _pick(rng, (".", "/", "  ", " - ", "_", " / ", "--")).join(d[i : i + 4] for i in range(0, len(d), 4))
    local, area, head = d[-7:], d[-10:-7], d[:-10]
    sep = _pick(rng, ("-", " ", ".", "/"))
    number = local[:3] + sep + local[3:]
    lead = _pick(rng, (f"{head} ({area}) ", f"({area}) ", f"plus {head} {area} ", f"00{head} {area} ", f"{area}{sep}", f"+{head} [{area}] ", f"+{head}/{area}/"))
    return (lead if head and area else "plus " if rng.random() < 0.5 else "00") + (number if head and area else d)


def lookalike(words: list[str], rng: np.random.Generator) -> str:
    """Text with digits or separators that is no personal data."""
    n, w = lambda k: _number(rng, k), lambda: _pick(rng, words)
    bad = n(16)
    bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
    return _pick(
        rng,
        (
            f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}:{n(2)}:{n(2)}", f"20{n(2)}-0{n(1)}-1{n(1)} 1{n(1)}:{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{n(3)},{n(3)},{n(3)}",
            bad, f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", f"{bad[:4]}/{bad[4:8]}/{bad[8:12]}", "".join(_pick(rng, "0123456789abcdef") for _ in range(32)), n(8), f"{n(3)}-{n(4)}",
            f"{w()} at {w()}. {w()}", f"{w()} at {w()} dot {w()}", f"{w()} @ {w()}", f"at {n(2)}.{n(2)}", f"{w()} dot {n(2)}", f"{n(2)} . {n(2)}", f"({w()}) [{n(2)}]", f"@{w()}", f"{w()} punto {w()}", f"{n(3)} dot {n(3)}",
        ),
    )


def windows_to_learn(text: str, spans: list[tuple[int, int, int]], length: int, rng: np.random.Generator, most: int = 4, times: int = 16) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``length`` characters of text each, with their spans: at most ``most`` of the text's spans (drawn), ``times`` times each, and look-alikes.

    Of eight windows one keeps the rules' form, with fresh digits and names; the others are written apart.
    """
    words = list({m[0]: None for m in _WORDS.finditer(text)}) or ["word"]
    out = []

    def place(core: str, kind: int | None, around: int) -> None:
        room = length - len(core) - 2
        if room < 0:
            return
        left = int(rng.integers(0, room + 1))
        before = re.sub(r"\S*[0-9@]\S*", " ", text[max(0, around - left) : around])
        after = re.sub(r"\S*[0-9@]\S*", " ", text[around : around + room - left])
        # Personal data is met in sentences, brackets and junk alike.
        edge = _pick(rng, ((" ", " "), (" ", ". "), (" ", ", "), ("(", ")"), (": ", "\n"), (" ", "!"), ('"', '"'), (" ", "###")))
        head = before + edge[0]
        whole = (head + core + edge[1] + after)[:length]
        if len(head) + len(core) <= length:
            out.append((whole, [] if kind is None else [(len(head), len(head) + len(core), kind)]))

    drawn = [spans[i] for i in rng.permutation(len(spans))[:most]]
    for a, b, kind in drawn:
        for turn in range(times):
            s = fresh(kind, text[a:b], words, rng)
            place(s if turn % 8 == 0 else apart(kind, s, rng), kind, int(rng.integers(0, len(text) + 1)) if turn % 2 else a)
    for _ in range(8 * len(drawn) or 4):
        place(lookalike(words, rng), None, int(rng.integers(0, len(text) + 1)))
    return out
