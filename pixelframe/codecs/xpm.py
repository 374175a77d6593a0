"""X pixmaps, version 3."""

from __future__ import annotations

import re

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, quantise, with_alpha
from .bits import check_size
from .xbm import identifier

_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')
#: Names that X knows and their colours; greys and numbered shades follow from a rule.
NAMED = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "00ff00", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff",
    "magenta": "ff00ff", "gray": "bebebe", "grey": "bebebe", "orange": "ffa500", "purple": "a020f0", "brown": "a52a2a", "pink": "ffc0cb",
    "gold": "ffd700", "navy": "000080", "maroon": "b03060", "violet": "ee82ee", "turquoise": "40e0d0", "tan": "d2b48c", "salmon": "fa8072",
    "khaki": "f0e68c", "coral": "ff7f50", "beige": "f5f5dc", "ivory": "fffff0", "orchid": "da70d6", "plum": "dda0dd", "sienna": "a0522d",
    "chocolate": "d2691e", "firebrick": "b22222", "tomato": "ff6347", "skyblue": "87ceeb", "steelblue": "4682b4", "royalblue": "4169e1",
    "dodgerblue": "1e90ff", "forestgreen": "228b22", "seagreen": "2e8b57", "limegreen": "32cd32", "darkgreen": "006400", "darkblue": "00008b",
    "darkred": "8b0000", "darkgray": "a9a9a9", "darkgrey": "a9a9a9", "lightgray": "d3d3d3", "lightgrey": "d3d3d3", "lightblue": "add8e6",
    "lightgreen": "90ee90", "lightyellow": "ffffe0", "slategray": "708090", "slategrey": "708090", "dimgray": "696969", "dimgrey": "696969",
    "gainsboro": "dcdcdc", "wheat": "f5deb3", "snow": "fffafa", "linen": "faf0e6", "lavender": "e6e6fa", "crimson": "dc143c", "indigo": "4b0082",
    "teal": "008080", "olive": "808000", "silver": "c0c0c0", "lime": "00ff00", "aqua": "00ffff", "fuchsia": "ff00ff", "midnightblue": "191970",
}
#: Characters that name colours in what is written.
ALPHABET = " .+@#$%&*=-;>,')!~{]^/(_:<[}|1234567890abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ`"


def colour_of(text: str) -> tuple[int, int, int, int]:
    value = text.strip()
    if value.lower() == "none":
        return 0, 0, 0, 0
    if value.startswith("#"):
        digits = value[1:]
        if len(digits) not in (3, 6, 9, 12) or not re.fullmatch("[0-9a-fA-F]+", digits):
            raise DecodeFailed("a colour is no hexadecimal number")
        n = len(digits) // 3
        parts = [int(digits[i * n : i * n + n], 16) for i in range(3)]
        return *((p * 17 if n == 1 else p >> 4 * (n - 2)) for p in parts), 255
    if value.startswith("%"):
        raise DecodeFailed("HSV colours are not read")
    name = value.lower().replace(" ", "")
    shade = re.fullmatch(r"gr[ae]y(\d{1,3})", name)
    if shade and int(shade[1]) <= 100:
        v = int(int(shade[1]) * 255 / 100 + 0.5)
        return v, v, v, 255
    if name not in NAMED:
        raise DecodeFailed("a colour has no known name")
    v = int(NAMED[name], 16)
    return v >> 16, v >> 8 & 255, v & 255, 255


def decode(data: bytes) -> Raster:
    text = data.decode("latin-1")
    # Comments are skipped outside strings only.
    parts = re.findall(r'/\*.*?\*/|"(?:[^"\\]|\\.)*"', text[text.find("{") :], flags=re.S)
    lines = [re.sub(r"\\(.)", r"\1", p[1:-1]) for p in parts if p.startswith('"')]
    try:
        width, height, n, per = (int(x) for x in lines[0].split()[:4])
    except (IndexError, ValueError):
        raise DecodeFailed("the values are missing") from None
    check_size(width, height)
    if n < 1 or not 1 <= per <= 8 or len(lines) < 1 + n + height:
        raise DecodeFailed("there are fewer lines than are stated")
    table = {}
    for line in lines[1 : 1 + n]:
        key, words = line[:per], line[per:].split()
        visuals, now = {}, None
        for w in words:
            if w in ("c", "g", "g4", "m", "s") and now != w and (now is None or visuals.get(now)):
                now = w
                visuals[now] = ""
            elif now:
                visuals[now] += (" " if visuals[now] else "") + w
        chosen = next((visuals[v] for v in ("c", "g", "g4", "m") if visuals.get(v)), None)
        if chosen is None:
            raise DecodeFailed("a colour has no value")
        table[key] = colour_of(chosen)
    keys = {k: i for i, k in enumerate(table)}
    palette = np.array(list(table.values()), np.uint8)
    index = np.zeros((height, width), np.int64)
    for y, line in enumerate(lines[1 + n : 1 + n + height]):
        if len(line) != width * per:
            raise DecodeFailed("a row has another length than is stated")
        try:
            index[y] = [keys[line[x : x + per]] for x in range(0, len(line), per)]
        except KeyError:
            raise DecodeFailed("a pixel has no colour") from None
    return with_alpha(palette[index])


def encode(image: Raster, name: str = "image") -> bytes:
    """At most 256 colours, the transparent one as ``None``."""
    found = quantise(image, 256)
    n = len(found.palette)
    per = 1 if n <= len(ALPHABET) else 2
    keys = [ALPHABET[i] if per == 1 else ALPHABET[i % len(ALPHABET)] + ALPHABET[i // len(ALPHABET)] for i in range(n)]
    colours = ["None" if i == found.transparent else "#{:02X}{:02X}{:02X}".format(*c[:3]) for i, c in enumerate(found.palette.tolist())]
    lines = [f"{image.width} {image.height} {n} {per}", *(f"{k} c {c}" for k, c in zip(keys, colours, strict=True))]
    lines += ["".join(keys[i] for i in row) for row in found.indices.tolist()]
    body = ",\n".join(f'"{line}"' for line in lines)
    return f"/* XPM */\nstatic char *{identifier(name)}[] = {{\n{body}\n}};\n".encode()


__all__ = ["colour_of", "decode", "encode"]
