"""Shape patterns of phrases, and their translation to the JVM's dialect.

Patterns are written in Python's dialect, where ``\\d``, ``\\w`` and ``\\s``
are Unicode-aware and ``$`` and ``.`` know only the line feed as a line end.
"""

from __future__ import annotations

import re

#: Level-1 kanji of JIS X 0208, in code order.
KANJI = "".join(
    bytes([row, cell]).decode("euc_jp")
    for row in range(0xB0, 0xD0)
    for cell in range(0xA1, 0xFF if row < 0xCF else 0xD4)
)
_KANA, _GANA, _WIDE = "[ァ-ヶー]", "[ぁ-ゖ]", "[Ａ-Ｚ]"
_HALF = "[ｦ-ﾟ]"


def _n(low: int, high: int | str = "") -> str:
    return "{%s,%s}" % (low, high)


def positive_patterns(mode: str = "repaired", kanji: str = KANJI) -> dict[str, str]:
    """Patterns a phrase must match entirely, one of them at least.

    mode "shipped": kanji and ASCII words count as matching only if "2,"
    follows a single character, so that none of them ever passes the length
    filter. mode "repaired": words of two characters or more.
    """
    if mode not in ("repaired", "shipped"):
        raise ValueError(mode)
    two = _n(2)
    broken = "(2,)" if mode == "shipped" else two
    k = f"[{kanji}]"
    return {
        "Kana": _KANA + two,
        "Hana": _HALF + two,
        "HAN": k + broken,
        "ZA": _WIDE + two,
        "alpha": "[a-zA-Z]" + broken,
        "ALPHA": "[A-Z]" + broken,
        "Kana_HAN": f"^{_KANA}+{k}+",
        "HAN_Kana": f"^{k}+{_KANA}+",
        "HAN_GaKa": f"^{k}+{_GANA}+{_KANA}+",
        "ZaGaKa": f"^{_WIDE}+{_GANA}+{k}+",
        "Kana_Gana": f"^{_KANA}{two}{_GANA}{two}",
    }


def _money(zero: str, first: str, tail: str, unit: str, amount: str = "[千|万|億|兆]?") -> str:
    group = "((," + tail + "{3})" + _n(0, 2) + ")"
    return "^(" + zero + "|(" + first + "(" + tail + _n(0, 2) + ")" + group + "))" + amount + unit + "$"


def _phone() -> dict[str, str]:
    d, gap = r"\d", r"(\s|-)"
    area = f"({d}{_n(2, 4)}|\\({d}{_n(2, 4)}\\))"
    return {
        "x_Phone": f"({area}{gap}({d}{_n(3, 4)}){gap}({d}" + "{4}))",
        "x_Tel": "[(]?" + d + _n(2, 4) + "[-)]?" + d + _n(2, 4) + "-" + d + _n(3, 4),
        "x_mobile": "0[789]0" + "-[0-9]{4}" * 2 + "$",
    }


def _address() -> dict[str, str]:
    name = "a-zA-Z0-9"
    return {
        "x_mail": f"[{name}_.+-]+@[{name}-]+" + r"\." + f"[{name}-.]+",
        "x_url": "https?://" + "[" + r"\w" + "/:%#" + r"\$&\?\(\)~\.=\+\-" + "]+",
    }


def _start(extra: str = "") -> str:
    return "^[ンッー、んっ～。" + extra + "](.*)+"


def negative_patterns(start_extra: str = "") -> dict[str, str]:
    """Patterns a phrase must not match entirely."""
    d = r"\d"
    money = {f"x_{name}": _money("[0０]", f"[{d}]", d, unit) for name, unit in (("Yen", "円"), ("Dollar", "ドル"), ("Euro", "ユーロ"))}
    return {
        "x_Gana": _GANA + "+",
        "x_smalla": r"[a-z\* _.]+",
        "x_start": _start(start_extra),
        **money,
        **_phone(),
        **_address(),
        "x_Num": f"[{d},，]+",
        "x_ymd": f"{d}{{4}}[-年/]{d}{_n(1, 2)}[-月/]{d}{_n(1, 2)}日?",
        "x_Num_ymd": f"[{d}]{_n(1, 4)}[日|月|年]",
    }


def documented_positive(mode: str = "repaired") -> dict[str, str]:
    """The set given as an example in documentation: only HAN and Kana_Gana
    are broken when shipped."""
    fixed, out = positive_patterns("repaired"), positive_patterns(mode)
    return out | {"alpha": fixed["alpha"], "ALPHA": fixed["ALPHA"]} | (
        {"Kana_Gana": f"^{_KANA}(2,){_GANA}(2,)"} if mode == "shipped" else {}
    )


def documented_negative() -> dict[str, str]:
    """The documentation's 16 keys, with separate half- and full-width money."""
    d, w, both = r"\d", "[０-９]", "[0-9０-９"
    base = negative_patterns()
    phone = _phone() | _address()
    return {
        "x_Gana": base["x_Gana"],
        "x_smalla": base["x_smalla"],
        "x_start": base["x_start"],
        "x_money": _money("0", "[1-9]", d, "円"),
        "x_Money": _money("[0０]", "[1-9１-９]", d, "円"),
        "x_MONEY": _money("０", "[１-９]", d, "円"),
        "x_dol": _money("0", "[1-9]", d, "ドル", ""),
        "x_DOL": _money("０", "[１-９]", w, "ドル", ""),
        "x_tel": phone["x_Tel"],
        "x_phone": phone["x_Phone"],
        "x_mobile": phone["x_mobile"],
        "x_mail": phone["x_mail"],
        "x_url": phone["x_url"],
        "x_Num": both + ",，]+",
        "x_Num_ymd": both + "]" + _n(1, 4) + "[日|月|年]",
        "x_ymd": f"{d}{{4}}[年/]{d}{_n(1, 2)}[月/]{d}{_n(1, 2)}日?",
    }


def notebook_positive(mode: str = "repaired") -> dict[str, str]:
    """The notebook's order and key names."""
    fixed, out = positive_patterns("repaired"), positive_patterns(mode)
    order = ["Kana", "Hana", "Kana_HAN", "HAN_Kana", "HAN", "ZA", "alpha", "ALPHA", "HAN_GaKa", "ZaGaKa", "Kana_Gana"]
    return {("Alpha" if k == "alpha" else k): (out if k == "HAN" else fixed)[k] for k in order}


def notebook_negative() -> dict[str, str]:
    return negative_patterns("ヲを")


_CLASS = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r"\t-\r\x1c-\x20\x85\p{Z}"}
_UNSUPPORTED = re.compile(r"\(\?(?:P|<[a-zA-Z]|\(|[aLux])|\\[AZbBDWSNzGpPQE]")


def _java_class(members: str) -> str:
    """A large set of single characters as unions that fail fast: Java tests
    the members of a class one after another."""
    blocks: dict[int, str] = {}
    for c in sorted(set(members)):
        blocks[ord(c) >> 7] = blocks.get(ord(c) >> 7, "") + c
    parts = "".join(f"[{b[0]}-{b[-1]}&&[{b}]]" for b in blocks.values())
    return f"[{min(members)}-{max(members)}&&[{parts}]]"


_LARGE_CLASS = re.compile(r"\[([\u3041-\u9fff]{100,})\]")


def translate(pattern: str, java: bool = True) -> str:
    """``pattern`` in Java's dialect, or (java=False) in RE2's.

    Raises ValueError for constructs that have no faithful translation.
    """
    re.compile(pattern)
    if m := _UNSUPPORTED.search(pattern.replace("\\\\", "..")):
        raise ValueError(f"no translation for {m.group(0)!r} in {pattern!r}")
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            body = _CLASS.get(e)
            out.append(c + e if body is None else body if inside or e == "d" else f"[{body}]")
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" or (c == "&" and pattern[i + 1 : i + 2] == "&"):
                out.append("\\")
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1] == "]":
                out.append("\\]")
                i += 1
            i += 1
            continue
        out.append(c)
        i += 1
    text = "".join(out)
    return "(?d)" + _LARGE_CLASS.sub(lambda m: _java_class(m.group(1)), text) if java else text
