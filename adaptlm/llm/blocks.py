"""Main-text extraction: a recurrent network labels every block of a page.

A page is read into blocks: runs of text between block-level tags, with the path of
open elements. Each block becomes a vector (hashed tags and classes of its path, hashed
words, lengths and link share). A bidirectional LSTM in numpy reads the
page's blocks in order, so each label depends on the whole page. It is trained
here, on pages drawn from templates.
"""

from __future__ import annotations

import functools
import html
import os
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import slices, small_batches, tidy
from adaptlm.llm.words import text_bytes, word_hashes

#: Fixed values of HTML: elements without an end tag, with raw text, that do not break a block, and that are never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style head title template svg annotation annotation-xml mphantom iframe object embed noembed noframes noscript select datalist textarea".split())
#: Elements that only change how text looks: no part of a path.
LOOKS = MATH | frozenset("b big em font i mark s small strike strong tt u".split())
#: Elements that can stand in a head; another one ends it, as does text.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: What an element that opens closes, within its nearest holder.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table td th tr ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

PATH, LAST, WORDS, NUMBERS = 48, 16, 32, 10
WIDTH, HIDDEN_UNITS = PATH + LAST + WORDS + NUMBERS, 24


@dataclass
class Block:
    """A run of text; path: bits of the hashed names of its open elements, the PATH low ones of all, the others from the last block-level element on."""

    text: str
    path: int
    linked: int


@functools.lru_cache(20_000)
def _bits(names: tuple[str, ...]) -> tuple[int, int]:
    """Bits of an element's names in each part of a path."""
    whole = last = 0
    for n in names:
        h = zlib.crc32(n.encode())
        whole, last = whole | 1 << h % PATH, last | 1 << h % LAST
    return whole, last


class _Page:
    """The open elements of a page while it is read; each step takes the time of what it opens or closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by name
        self.holders: list[int] = []
        self.hidden = self.links = 0

    def push(self, name: str, names: tuple[str, ...]) -> None:
        whole, last = self.stack[-1][1:] if self.stack else (0, 0)
        own = _bits(names)
        self.stack.append((name, whole | own[0], own[1] if names and name not in INLINE else last | own[1]))
        self.places.setdefault(name, []).append(len(self.stack) - 1)
        if name in HOLDERS:
            self.holders.append(len(self.stack) - 1)
        self.hidden += name in HIDDEN
        self.links += name == "a"

    def cut(self, at: int) -> None:
        """Close all elements from the given place on."""
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in HOLDERS:
                self.holders.pop()
            self.hidden -= name in HIDDEN
            self.links -= name == "a"

    def last(self, name: str) -> int:
        """The place of the innermost open element of this name, or -1."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def close(self, names: tuple[str, ...]) -> None:
        """End the innermost open element of these names, unless a holder lies between."""
        at = max(map(self.last, names))
        if at >= 0 and at >= (self.holders[-1] if self.holders else 0):
            self.cut(at)

    @property
    def path(self) -> int:
        return self.stack[-1][1] | self.stack[-1][2] << PATH if self.stack else 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with their decoded text (white space as single spaces, never empty), in time that grows with the page's length."""
    out: list[Block] = []
    parts: list[str] = []
    open_now = _Page()
    path, linked, filled = 0, 0, False

    def flush() -> None:
        nonlocal linked, filled
        if filled:
            out.append(Block(" ".join("".join(parts).split()), path, linked))
        parts.clear()
        linked, filled = 0, False

    def say(raw: str) -> None:
        nonlocal path, linked, filled
        if open_now.stack and open_now.stack[-1][0] == "head" and raw.strip():
            open_now.cut(len(open_now.stack) - 1)
        if raw and not open_now.hidden:
            text = html.unescape(raw)
            bare = text.strip()
            if not filled:
                path, filled = open_now.path, bool(bare)
            parts.append(text)
            if open_now.links:
                linked += len(bare)

    at, end = 0, len(page)
    last_end, last_data = page.rfind(">"), page.rfind("]]>")
    while at < end:
        if at > last_end:  # no tag can end here; a comment may be open
            rest = page.find("<!--", at)
            say(page[at:] if rest < 0 else page[at:rest])
            break
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[0] == "<![CDATA[":
            stop = page.index("]]>", at) if at <= last_data else page.index(">", at) if at <= last_end else end
            if at <= last_data:
                say(page[at:stop])
            at = min(stop + (3 if at <= last_data else 1), end)
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name in ("br", "wbr", "img") and parts:
            parts.append(" " if name == "br" else "")
        if m[1] or m[4]:
            if (place := open_now.last(name)) >= 0:
                open_now.cut(place)
            continue
        # what is in a noscript or a template is no part of the head
        if name == "body" or name not in IN_HEAD and open_now.stack and open_now.stack[-1][0] == "head":
            if heads := open_now.places.get("head"):
                open_now.cut(heads[0])
        if name in VOID:
            continue
        if name in RAW:
            stop = _END[name].search(page, at)
            if name not in HIDDEN:
                say(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        if name in CLOSED_BY:
            open_now.close(CLOSED_BY[name])
        if name not in INLINE:
            open_now.close(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
        attrs = m[3] if m[2] else m[6]
        names = tuple(f".{x.lower()}" for g in _NAMES.findall(attrs) for x in _PART.findall("".join(g))) if attrs else ()
        open_now.push(name, () if name in LOOKS else (name, *names))
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """[block, WIDTH] of a page or of several pages' blocks end to end."""
    n = len(blocks)
    x = np.zeros((n, WIDTH), np.float32)
    paths = np.array([b.path for b in blocks], np.uint64)
    x[:, : PATH + LAST] = (paths[:, None] >> np.arange(PATH + LAST, dtype=np.uint64)) & np.uint64(1)
    h, counts = word_hashes(*text_bytes(pa.array([b.text for b in blocks], pa.large_string())))
    many = np.diff(counts)
    bag = np.bincount(np.repeat(np.arange(n), many) * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    x[:, PATH + LAST : PATH + LAST + WORDS] = np.log1p(bag) / 3
    size = np.array([len(b.text) for b in blocks], float)
    stops = np.array([sum(map(b.text.count, ".,;:?!")) for b in blocks], float)
    share = np.array([b.linked for b in blocks]) / np.maximum(size, 1)
    ends = np.array([b.text[-1] in ".!?:\"'”»" for b in blocks], float)
    caps = np.array([b.text[0].isupper() for b in blocks], float)
    mark = np.array([any(c in b.text for c in "©»›·•") for b in blocks], float)
    x[:, -NUMBERS:] = np.stack([np.log1p(many) / 4, np.log1p(size) / 5, np.minimum(share, 1), stops / np.maximum(many, 1), ends, caps, mark, many < 4, many > 25, np.ones(n)], 1)
    return x


class Labeller:
    """Two LSTMs over a page's blocks, one from each end, and a logistic unit on their states."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN_UNITS, WIDTH
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, d**-0.5, (d, 4 * h))
            self.w[f"h{side}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            self.w[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w["out"] = rng.normal(0, h**-0.5, 2 * h)
        self.w["bias"] = np.zeros(1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, state: tuple | None = None, keep: bool = False) -> tuple[np.ndarray, list, tuple]:
        """States [time, page, unit] from the first block on, what training needs of them (if keep) and the last state; mask [time, page] is 0 beyond a page's end."""
        h_n = HIDDEN_UNITS
        xs = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h, c = state or (np.zeros((x.shape[1], h_n)),) * 2
        out, kept = np.empty((*x.shape[:2], h_n)), []
        for t in range(len(x)):
            z = xs[t] + h @ self.w[f"h{side}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_n], -30, 30)))
            i, f, o, g = gates[:, :h_n], gates[:, h_n : 2 * h_n], gates[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            if keep:
                kept.append((h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[t] = h
        return out, kept, (h, c)

    def _sides(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, kf, _ = self._run("f", x, mask, keep=keep)
        backward, kb, _ = self._run("b", x[::-1], mask[::-1], keep=keep)
        return np.concatenate([forward, backward[::-1]], 2), kf, kb

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = self._sides(x, mask)[0]
        return both @ self.w["out"] + self.w["bias"]

    def long_scores(self, blocks: list[Block], step: int) -> np.ndarray:
        """Scores of a page's blocks, step blocks at a time: one number a block is held besides the states of a step."""
        out = np.full(len(blocks), self.w["bias"][0])
        cuts = [(k, min(k + step, len(blocks))) for k in range(0, len(blocks), step)]
        for side, order, weight in (("f", cuts, self.w["out"][:HIDDEN_UNITS]), ("b", cuts[::-1], self.w["out"][HIDDEN_UNITS:])):
            state, turn = None, 1 if side == "f" else -1
            for a, b in order:
                x = vectors(blocks[a:b])[::turn, None]
                states, _, state = self._run(side, x, np.ones(x.shape[:2], bool), state)
                out[a:b] += (states[:, 0] @ weight)[::turn]
        return out

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float32) for k, v in self.w.items()})

    @classmethod
    def load(cls, path: str) -> Labeller:
        model = cls(0)
        with np.load(path) as found:
            model.w = {k: found[k].astype(float) for k in model.w}
        return model

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss."""
        both, kf, kb = self._sides(x, mask, True)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["bias"], -30, 30)))
        d = np.where(mask, p - y, 0) / mask.sum()
        g = {"out": np.einsum("tp,tpu->u", d, both), "bias": d.sum(keepdims=True).reshape(1)}
        dh = d[:, :, None] * self.w["out"]
        g |= self._back("f", x, kf, dh[:, :, :HIDDEN_UNITS]) | self._back("b", x[::-1], kb, dh[::-1, :, HIDDEN_UNITS:])
        return g

    def _back(self, side: str, x: np.ndarray, kept: list, dh_out: np.ndarray) -> dict[str, np.ndarray]:
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN_UNITS))
        gh = np.zeros_like(self.w[f"h{side}"])
        dh = dc = np.zeros((x.shape[1], HIDDEN_UNITS))
        for t in range(len(x) - 1, -1, -1):
            h0, c0, i, f, o, g, tc, m = kept[t]
            dh = dh + dh_out[t]
            dct = dc + np.where(m, dh * o * (1 - tc**2), 0)
            dz = np.where(m, np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - g**2)], 1), 0)
            gh += h0.T @ dz
            dh, dc = np.where(m, 0, dh) + dz @ self.w[f"h{side}"].T, np.where(m, dct * f, dc)
            dz_all[t] = dz
        flat = dz_all.reshape(-1, dz_all.shape[2])
        return {f"x{side}": x.reshape(-1, x.shape[2]).T @ flat, f"h{side}": gh, f"c{side}": flat.sum(0)}


# --- training pages ---

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve os la que ci ado mente die ich ung sch ver bar keit é ü ß ñ eau oi ment ais".split()
#: Names that page authors give to the parts of a page.
_JUNK_NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs sitenav links tabs pagination",
    "header": "header masthead banner top branding site-header topbar logo",
    "footer": "footer bottom copyright legal site-footer colophon credits",
    "aside": "sidebar aside widget related rail recommended popular trending side tags secondary more",
    "notice": "notice cookie consent alert gdpr message banner popup modal warning disclaimer newsletter subscribe",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adbox",
    "form": "form search login signup contact newsletter subscribe",
    "comments": "comments comment replies discussion disqus respond reactions responses feedback",
    "share": "share social sharing follow buttons toolbar meta byline",
}
_MAIN_NAMES = "article content post entry story main body text article-body post-content entry-content page story-body prose".split()
_IN, _OUT = "", ""


class _Pages:
    """Draws pages whose text runs begin with a private mark: _IN for main text, _OUT for the rest."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        s = self.words(3, 18)
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s[:1].upper() + s[1:] + self.r.choice(".........?!")

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def odd(self, s: str, style: int) -> str:
        """Writing that is poor but an article's all the same: bars, shouting, symbols, words said again and again."""
        words = s.split()
        if style == 0:
            return " | ".join(words)
        if style == 1:
            return " ".join(w.upper() + "!!" for w in words)
        if style == 2:
            return " ".join(w + self.r.choice(("###", "***", "%%%", "&amp;&amp;&amp;", "&&&", "$$$")) for w in words)
        return " ".join(w for w in words[: self.r.randint(1, 9)] for _ in range(self.r.randint(5, 40)))

    def inline(self, s: str) -> str:
        r = self.r.random()
        if r < 0.15:
            return f"<b>{s}" + ("</b>" if self.r.random() < 0.6 else "<br>")
        if r < 0.25:
            return re.sub(r" (\S+) ", r' <a href="/x">\1</a> ', s, count=1)
        return s

    def named(self, kind: str | None, names: str | list[str], tags: tuple[str, ...]) -> tuple[str, str]:
        tag = self.r.choice(tags)
        names = names.split() if isinstance(names, str) else names
        r = self.r.random()
        attr = "" if r < 0.2 and tag not in ("div", "section", "ul") else f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}{self.r.choice(("", "", "-" + self.word(), " " + self.word()))}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self.word()}">{_OUT}{self.words(1, 4).capitalize() if self.r.random() < 0.5 else self.words(1, 4)}</a>' for _ in range(self.r.randint(a, b))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * (self.r.random() < 0.8) for x in items) + "</ul>"
        return f"<div>{' | '.join(items)}</div>"

    def junk(self, kind: str) -> str:
        r = self.r
        tags = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "aside", "div", "section"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol")}.get(kind, ("div", "div", "section", "p"))
        a, b = self.named(kind, _JUNK_NAMES[kind], tags)
        if kind == "nav":
            return a + self.links(2, 8) + b
        if kind == "header":
            return a + f"{r.choice(('<h1>', '<div>', '<a href=/>'))}{_OUT}{self.words(1, 5)}</div>" + (self.links(2, 6) if r.random() < 0.5 else "") + b
        if kind == "footer":
            return a + (f"<p>{_OUT}" if r.random() < 0.5 else _OUT) + r.choice(("&copy; ", "&copy; 2024 ", "© ", "")) + (self.words(1, 3) if r.random() < 0.5 else f"{self.word()}.{self.word()}.example.{r.choice(('com', 'org', 'net'))}") + r.choice((" &middot; ", " | ", " ")) + (self.prose(1, 2) if r.random() < 0.6 else self.words(2, 8)) + (self.links(1, 5) if r.random() < 0.4 else "") + b
        if kind == "aside":
            return a + f"<h3>{_OUT}{self.words(1, 4)}</h3>" + (self.links(2, 6) if r.random() < 0.7 else f"<p>{_OUT}{self.prose(1, 3)}</p>") + b
        if kind == "form":
            return a + "".join(f"<label>{_OUT}{self.words(1, 3)}</label><input name=x>" if r.random() < 0.7 else f"<p>{_OUT}{self.words(2, 9)}</p>" for _ in range(r.randint(1, 3))) + f"<button>{_OUT}{self.words(1, 2)}</button>" + b
        if kind == "comments":
            item = "li" if "ol" in a else "div"
            body = "".join(f'<{item} class="{r.choice(("comment", "reply", "comment-body", "c"))}"><{r.choice(("b", "span", "h4"))}>{_OUT}{self.words(1, 2)}</b></h4>' + f"<p>{_OUT}{self.prose(1, 4)}</p></{item}>" for _ in range(r.randint(1, 5)))
            return a + f"<h3>{_OUT}{self.words(1, 3)}</h3>" * (r.random() < 0.7) + body + b
        if kind == "share":
            return a + "".join(f"<span>{_OUT}{self.words(1, 2)}</span> " for _ in range(r.randint(1, 4))) + b
        return a + r.choice(("", "<p>", "<span>")) + _OUT + (self.prose(1, 2) if r.random() < 0.7 else self.words(2, 8)) + (f' <a href="/y">{self.words(1, 2)}</a>' if r.random() < 0.4 else "") + b

    def main(self) -> str:
        r = self.r
        a, b = self.named(None, _MAIN_NAMES, r.choice((("article",), ("article", "main"), ("div", "section", "div", "td"))))
        out = [f"<h1>{_IN}{self.words(3, 12).capitalize()}</h1>"] if r.random() < 0.8 else []
        style = r.choice((0, 1, 2, 3)) if r.random() < 0.2 else None
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            k = r.random()
            if k < 0.72:
                said = self.prose(*r.choice(((1, 1), (1, 4), (2, 9), (5, 25))))
                out.append(f"<p>{_IN}" + self.inline(said if style is None or r.random() < 0.2 else self.odd(said, style)) + "</p>" * (r.random() < 0.9))
            elif k < 0.8:
                out.append(f"<h{r.choice('234')}>{_IN}{self.words(1, 7).capitalize()}</h2>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{_IN}{self.words(2, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote><p>{_IN}{self.prose(1, 3)}</p></blockquote>")
            elif k < 0.93:
                out.append(f"<table><tr><td>{_IN}{self.words(1, 5)}</td><td>{_IN}{self.words(1, 5)}</td></tr></table>")
            elif k < 0.95:
                out.append(f"<figure><img src=x><figcaption>{_IN}{self.words(3, 12)}</figcaption></figure>")
            else:
                out.append(self.junk(r.choice(("ad", "share", "notice", "aside", "form"))))
        if "<h1" not in a and r.random() < 0.1:
            out.insert(0, f"<header><h1>{_IN}{self.words(2, 9)}</h1></header>")
        return a + "".join(out) + b

    def page(self) -> str:
        r = self.r
        before = [self.junk(r.choice(("nav", "nav", "header", "ad", "notice", "form", "aside", "share"))) for _ in range(r.choice((0, 1, 1, 2, 2, 3, 4)))]
        after = [self.junk(r.choice(("footer", "footer", "ad", "aside", "comments", "comments", "share", "notice", "nav", "form"))) for _ in range(r.choice((0, 1, 1, 2, 2, 3, 4)))]
        body = "".join(before) + (self.main() if r.random() < 0.96 else "") + "".join(after)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(("wrapper", "container", "page", "site", "layout", self.word()))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


def _marked(page: str) -> tuple[list[Block], np.ndarray]:
    blocks = blocks_of(page)
    y = np.array([_IN in b.text for b in blocks], float)
    clean = [Block(" ".join(b.text.translate({0xE000: "", 0xE001: ""}).split()), b.path, b.linked) for b in blocks]
    full = [k for k, b in enumerate(clean) if b.text]
    return [clean[k] for k in full], y[full]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[time, page, WIDTH] and the mask of blocks that are there."""
    most = max(map(len, pages))
    x, mask = np.zeros((most, len(pages), WIDTH), np.float32), np.zeros((most, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def trained(pages: int = 2400, passes: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Labeller:
    """A labeller fitted with Adam on pages drawn from the templates; the same for the same arguments."""
    made, model = _Pages(seed), Labeller(seed)
    drawn = [x for x in (_marked(made.page()) for _ in range(pages)) if x[0]]
    drawn = [(vectors(b), y) for b, y in drawn]
    drawn.sort(key=lambda x: len(x[1]))
    m, v, step, rng = {k: 0.0 for k in model.w}, {k: 0.0 for k in model.w}, 0, np.random.default_rng(seed)
    groups = [drawn[i : i + batch] for i in range(0, len(drawn), batch)]
    for n in range(passes):
        for k in rng.permutation(len(groups)):
            x, mask = padded([p for p, _ in groups[k]])
            y = np.zeros(mask.shape)
            for j, (_, labels) in enumerate(groups[k]):
                y[: len(labels), j] = labels
            step += 1
            for name, g in model.slopes(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.99 * v[name] + 0.01 * g * g
                model.w[name] = model.w[name] - rate * (0.5 if n >= passes - 2 else 1) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return model


#: Weights that `python -m adaptlm.llm.blocks` has trained, with trained()'s own arguments.
WEIGHTS = os.path.join(os.path.dirname(__file__), "block_weights.npz")


@functools.lru_cache(1)
def default_labeller() -> Labeller:
    """The labeller with the weights kept beside this module."""
    return Labeller.load(WEIGHTS)


def main_blocks(pages: list[str], model: Labeller, most: int = 20_000) -> Iterator[list[tuple[Block, bool]]]:
    """For each page its blocks and whether each is main text; a page is read whole, most bounds the padded blocks of a run."""
    read = [blocks_of(p) for p in pages]
    keep: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if read[k]), key=lambda k: len(read[k]))
    while order:
        some = [order.pop()]
        if len(read[some[0]]) > most:
            keep[some[0]] = model.long_scores(read[some[0]], most) > 0
            continue
        while order and (len(some) + 1) * len(read[some[0]]) <= most and len(some) < 256:
            some.append(order.pop())
        flat = vectors([b for k in some for b in read[k]])
        cut = np.cumsum([0, *(len(read[k]) for k in some)])
        x, mask = padded([flat[a:b] for a, b in zip(cut[:-1], cut[1:])])
        s = model.scores(x, mask)
        for j, k in enumerate(some):
            keep[k] = s[: len(read[k]), j] > 0
    for blocks, k in zip(read, keep):
        yield list(zip(blocks, k))


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points), n_blocks, n_main.

    text: main blocks in page order, one line each. Null and empty html give an empty
    text; repeated rows give a row each; an empty table none; other columns are ignored.
    """
    model = model or default_labeller()
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                text, n, main = [], [], []
                for found in main_blocks(part.column(2).to_pylist(), model):
                    text.append("\n".join(b.text for b, m in found if m))
                    n.append(len(found)), main.append(sum(bool(m) for _, m in found))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(n, pa.int64()), pa.array(main, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])
        tidy()

    small_batches(pages.sparkSession)
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_main long")


if __name__ == "__main__":
    trained().save(WEIGHTS)
