"""Main text of web pages by differences between pages of nearest URLs, with structure as support.

Pages are parsed to a tree of elements (end tags may be left out where HTML allows it)
and cut into text lines, one per block. Each page is compared with pages of the same
host whose URL paths are nearest: neighbours in the order of paths, since the longest
common prefix is always with one, other than copies of its lines. Lines are aligned by
a longest common subsequence; those that most of the compared pages share are
frame and are deleted. Structure supports this where pages can't differ or can't agree:
what stands in elements that never hold article text goes, and where <article> or <main>
hold more than what else a page doesn't share with its neighbours only those are kept, of which only shared
lines made of links are deleted: two articles may quote the same paragraph, which is no boilerplate.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_starts

# HTML's element names by their part in parsing, its landmark elements and roles.
_NEVER = frozenset("nav footer aside form menu dialog button select option input textarea iframe svg canvas audio video map head title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_RAW = frozenset("script style noscript template textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCKS - frozenset("body html li dd dt tr tbody thead tfoot figcaption summary".split())
# An opened element ends these, up to the elements that bound them.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
_BOUNDS = frozenset("ul ol menu dl select table td th article main section aside nav header footer form div body html blockquote".split())
_HEAD_ONLY = frozenset("html head title base link meta style script noscript template".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# Words that are a whole class or id of what no neighbour shares, since it differs on each page.
UNSHARED = frozenset("ad ads advert advertisement comment comments".split())

MAIN, BODY, SKIP = "m", "b", "s"  # where a line stands; upper case if links make up more than half of it
SIDE, COMPARED = 3, 3  # differing pages looked at on each side, and of those the nearest that are compared


class _Parser:
    """Lines of a page: a stack of open elements says where text stands."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str]] = []
        self.stack: list[tuple[str, bool]] = []  # (name, whether this element hides what it holds)
        self.open_now: Counter[str] = Counter()
        self.soft: list[int] = []  # positions of those that an article in them would show again
        self.text: list[str] = []
        self.linked = self.total = 0
        self.hidden = self.main = self.links = 0  # open elements of each kind

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            flag = SKIP if self.hidden else MAIN if self.main else BODY
            self.out.append((flag.upper() if 2 * self.linked > self.total else flag, line))
        self.text.clear()
        self.linked = self.total = 0

    def put(self, raw: str) -> None:
        if raw:
            raw = entities.unescape(raw)
            n = len(raw.strip())
            if n and self.stack and self.stack[-1][0] == "head":
                self.pop(len(self.stack) - 1)  # text ends an open head
            self.text.append(raw)
            self.total += n
            self.linked += n if self.links else 0

    def pop(self, to: int) -> None:
        """Closes all elements from position ``to`` of the stack on."""
        for name, hides in self.stack[to:]:
            if name in _BLOCKS or hides:
                self.flush()
                break
        for name, hides in self.stack[to:]:
            self.open_now[name] -= 1
            self.hidden -= hides
            self.main -= name in ("article", "main")
            self.links -= name == "a"
        del self.stack[to:]
        while self.soft and self.soft[-1] >= to:
            self.soft.pop()

    def close(self, name: str) -> None:
        if not self.open_now[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.pop(k)
                return
            if name not in _BLOCKS and self.stack[k][0] in _BOUNDS:
                return  # an inline end tag without its start doesn't close blocks

    def open(self, name: str, attrs: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and name not in _HEAD_ONLY:
            self.pop(len(self.stack) - 1)
        if name in _ENDS:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in _ENDS[name]:
                    self.pop(k)
                elif self.stack[k][0] in _BOUNDS:
                    break
        elif name in _ENDS_P and self.open_now["p"]:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    self.pop(k)
                    break
                if self.stack[k][0] in _BOUNDS:
                    break
        if name == "a" and self.links:
            self.close("a")
        if name in _BLOCKS:
            self.flush()
        elif name in ("br", "td", "th", "option"):
            self.text.append(" ")
        if name in _VOID:
            return
        if name in ("article", "main"):
            for k in self.soft:  # a form or a landmark around the article isn't the page's frame
                self.stack[k] = (self.stack[k][0], False)
                self.hidden -= 1
            self.soft.clear()
        why = _hidden(attrs) if attrs and name not in ("html", "body") else ""
        if why == "id":
            why = "word" if name in _BLOCKS else ""  # a name within a line says nothing
        hides = name in _NEVER or name == "header" and not self.main or bool(why) and not (name in ("article", "main") and why == "role" or name == "main" and why == "word")
        if hides and name not in _BLOCKS:
            self.text.append(" ")
            self.flush()
        if hides and (name == "form" or name not in _NEVER and why == "role"):
            self.soft.append(len(self.stack))
        self.stack.append((name, hides))
        self.open_now[name] += 1
        self.hidden += hides
        self.main += name in ("article", "main")
        self.links += name == "a"


def _hidden(attrs: str) -> str:
    """Why an element's attributes hide it: "yes", "role", "word" (of its class), "id", or ""."""
    why = ""
    for key, value in _ATTR.findall(attrs):
        key, words = key.lower(), value.strip("\"'").lower().split()
        if key == "hidden" or key == "aria-hidden" and words == ["true"] or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "yes"
        if key == "role" and not _ROLES.isdisjoint(words):
            why = why or "role"
        elif key in ("class", "id") and not UNSHARED.isdisjoint(words):
            why = "word" if key == "class" else why or "id"
    return why


def lines_of(html: str) -> list[tuple[str, str]]:
    """(flag, line) for each block of a page, in order; white space is one space, references are decoded."""
    p, pos = _Parser(), 0
    while True:
        m = _TAG.search(html, pos)
        p.put(html[pos : m.start()] if m else html[pos:])
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            p.close(name)
        elif name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else len(html)
        else:
            p.open(name, m[3] or m[6] or "")
    p.flush()
    return p.out


# ---- alignment


def _rows(a: list, b: list) -> list[int]:
    """Bit rows of the table of common subsequences: bit j of row i is 0 where b[j] makes that of a[:i+1] and b[:j+1] longer."""
    where: dict = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(row: int, n: int) -> np.ndarray:
    """Longest common lengths for each prefix of b (0..n) from a bit row."""
    raw = np.frombuffer(row.to_bytes((n + 7) // 8, "little"), dtype=np.uint8)
    return np.concatenate(([0], np.cumsum(1 - np.unpackbits(raw, bitorder="little")[:n].astype(np.int64))))


def shared_lines(a: list, b: list) -> set[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``.

    Rows of bits make a table of 64 cells a machine word; tables above 2**26 cells are
    halved at the split of ``b`` that keeps the subsequence longest, so memory stays bounded.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out.add(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        inside = set(b[b0:b1])
        at = [k for k in range(a0, a1) if a[k] in inside]
        if not at:
            continue
        x, y = [a[k] for k in at], b[b0:b1]
        if len(x) == 1:
            out.add(at[0])
        elif len(x) * len(y) <= 1 << 26:
            rows, i, j = _rows(x, y), len(x), len(y)
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                    i -= 1
                else:
                    out.add(at[i - 1])
                    i, j = i - 1, j - 1
        else:
            mid = len(x) // 2
            front = _lengths(_rows(x[:mid], y)[-1], len(y))
            back = _lengths(_rows(x[mid:][::-1], y[::-1])[-1], len(y))[::-1]
            cut = b0 + int((front + back).argmax())
            todo += [(a0, at[mid], b0, cut), (at[mid], a1, cut, b1)]
    return out


def frame_lines(lines: list[str], others: list[list[str]]) -> set[int]:
    """Positions of the lines that more than half of the other pages share; no page shares where there is none."""
    count = np.zeros(len(lines), dtype=np.int64)
    for other in others:
        count[list(shared_lines(lines, other))] += 1
    return set(np.flatnonzero(2 * count > len(others)).tolist()) if others else set()


def main_text(flags: str, lines: list[str], frame: set[int] | None = None) -> str:
    """The page's article: lines that are neither frame nor in elements without article text.

    <article> or <main> count where they hold at least as much text as stands outside of them without being
    links or shared with neighbours: then only their lines stay, of which frame lines go only if made of links. An
    article that holds less, such as a teaser beside the story, is text like any other.
    """
    frame = frame or set()
    own = {"m": 0, "b": 0}
    for k, (f, x) in enumerate(zip(flags, lines)):
        if f == "m" or f == "b" and k not in frame:
            own[f] += len(x)
    marked = any(f in "mM" for f in flags) and own["m"] >= own["b"]
    keep = [x for k, (f, x) in enumerate(zip(flags, lines)) if f in ("mM" if marked else "mMbB") and not (k in frame and (not marked or f == "M"))]
    return "\n".join(keep)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _hash(flags: str, lines: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{flags}\n{lines}".encode()) >> 1


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_frame) for each row; n_frame of its n_lines lines are shared with neighbours.

    Null html is empty. Pages whose URL has no host (or is null) count as of one host
    ''; pages without lines aren't compared with others. Of pages in the order of (host, path, id) that
    have equal lines in a row, all have the same neighbours: three differing pages of the host
    before and after them, of which the three with the longest common path are compared
    (of equal ones the page before). Pages are dealt to ranges of that order, so a host
    of any size is spread, and each range gets the pages before and after it that
    its own are compared with: which pages are compared doesn't depend on ranges. A few
    keys of each range pass the driver. Pages are parsed twice, first for a hash of
    their lines; lines are shuffled once. Repeated rows, null and repeated ids give a row
    each; other columns aren't read, whatever their names. An empty table gives no rows.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    # one string in the order of (host, path, id, url); rows of equal keys stay in one range
    key = F.concat_ws("\u0001", host, path, F.coalesce(F.lpad(F.col(id_col).cast("string"), 20, "0"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")))
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), key.alias("key"), F.col(html_col).alias("html"))

    def parsed(html: str | None) -> tuple[str, str]:
        found = lines_of(html or "")
        return "".join(f for f, _ in found), "\n".join(t for _, t in found)

    starts = range_starts(slim, F.col("key"))
    n = max(len(starts), 1)

    def place(k: str) -> int:
        return max(bisect.bisect_right(starts, k) - 1, 0)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [parsed(h.as_py()) for h in batch.column(2)]
            parts = pa.array([place(k) for k in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([parts, batch.column(0), batch.column(1), pa.array([_hash(f, x) if f else None for f, x in both], pa.int64())], names=["part", "host", "key", "hash"])

    comparable = slim.select("host", "key", "html").mapInArrow(hashes, "part int, host string, key string, hash long").where("hash IS NOT NULL")
    ordered = comparable.repartitionById(n, "part").sortWithinPartitions("part", "key", "hash")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of the first runs of equal lines of each range and the last row of its last runs."""
        head: list[tuple] = []
        tail: deque = deque(maxlen=2 * SIDE + 1)
        before = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if before is None or (row[1], row[3]) != (before[1], before[3]):
                    if len(head) <= 2 * SIDE:
                        head.append(row)
                    tail.append(row)
                else:
                    tail[-1] = row
                before = row
        rows = [(*r, True) for r in head] + [(*r, False) for r in tail]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["part", "host", "key", "hash", "head"])

    edges = sorted(tuple(r) for r in ordered.mapInArrow(ends, "part int, host string, key string, hash long, head boolean").collect())
    extra: dict[str, set[int]] = {}  # the ranges that get a page of another one too
    for after in (True, False):
        # a range's own last (first) row, and the first (last) rows of the ranges after (before) it, nearest first
        borders = {e[0]: e for e in sorted((e for e in edges if e[4] != after), key=lambda e: e[2], reverse=not after)}
        side = sorted((e for e in edges if e[4] == after), key=lambda e: (e[0], e[2]), reverse=not after)
        places = [e[0] if after else -e[0] for e in side]
        for part, border in borders.items():
            runs, last = 0, border[3]
            for e in islice(side, bisect.bisect_right(places, part if after else -part), None):
                runs += e[3] != last
                if runs > 2 * SIDE or e[1] != border[1]:
                    break
                last = e[3]
                extra.setdefault(e[2], set()).add(part)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "halo", "id", "url", "host", "path", "key", "flags", "lines"]
        for batch in batches:
            take, part, halo, flags, text = [], [], [], [], []
            for k, (x, h) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5))):
                f, t = parsed(h.as_py())
                for p, is_halo in [(place(x), False), *((p, True) for p in sorted(extra.get(x, ())))]:
                    take.append(k)
                    part.append(p)
                    halo.append(is_halo)
                    flags.append(f)
                    text.append(t)
            rows = batch.select([0, 1, 2, 3, 4]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(halo, pa.bool_()), *rows.columns, pa.array(flags, pa.string()), pa.array(text, pa.string())], names=names)

    dealt = slim.mapInArrow(parse, "part int, halo boolean, id long, url string, host string, path string, key string, flags string, lines string")
    ranged = dealt.repartitionById(n, "part").sortWithinPartitions("part", "key", "lines")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal lines pass through a window of SIDE runs on each side."""
        runs: deque = deque()  # [(part, host), hash, flags, lines, first path, last path, [(id, url, path)] of own rows]
        ready: list[tuple] = []

        def finish(k: int) -> None:
            _, _, flags, lines, _, _, own = runs[k]
            if not own:
                return
            able = []
            for step, path_at in ((-1, 5), (1, 4)):
                at, n_found = k + step, 0
                while 0 <= at < len(runs) and n_found < SIDE:
                    if runs[at][1] != runs[k][1]:
                        able.append((runs[at][path_at], runs[at]))
                        n_found += 1
                    at += step
            made: dict[tuple, tuple] = {}
            for i, url_, path_ in own:
                best = sorted(range(len(able)), key=lambda c: -_prefix(able[c][0], path_))[:COMPARED]
                best = tuple(sorted(best))
                if best not in made:
                    frame = frame_lines(lines, [able[c][1][3] for c in best])
                    made[best] = (main_text(flags, lines, frame), len(lines), len(frame))
                ready.append((i, url_, *made[best]))

        def made_batch() -> pa.RecordBatch:
            cols = list(zip(*ready)) or [[]] * 5
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=[id_col, "url", "text", "n_lines", "n_frame"])
            ready.clear()
            return out

        done = 0  # runs before this position of ``runs`` are finished
        for batch in batches:
            for part, halo, i, url_, host_, path_, _, flags, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    if not halo:
                        ready.append((i, url_, "", 0, 0))
                    continue
                hashed = _hash(flags, text)
                if not runs or runs[-1][0] != (part, host_) or runs[-1][1] != hashed:
                    if runs and runs[-1][0] != (part, host_):
                        while done < len(runs):
                            finish(done)
                            done += 1
                        runs.clear()
                        done = 0
                    runs.append([(part, host_), hashed, flags, text.split("\n"), path_, path_, []])
                    # the run SIDE places back has all its neighbours, save that some may repeat its lines
                    while _settled(runs, done):
                        finish(done)
                        done += 1
                    while done > 0 and _settled_before(runs, done):
                        runs.popleft()
                        done -= 1
                runs[-1][5] = path_
                if not halo:
                    runs[-1][6].append((i, url_, path_))
            if ready:
                yield made_batch()
        while done < len(runs):
            finish(done)
            done += 1
        if ready:
            yield made_batch()

    out = ranged.mapInArrow(compare, f"{id_col} long, url string, text string, n_lines long, n_frame long")
    return out.select(id_col, "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_frame")


def _settled(runs: deque, at: int) -> bool:
    """Whether SIDE differing, closed runs with lines follow run ``at`` (the last one is still open)."""
    if at >= len(runs) - 1:
        return False
    found = 0
    for k in range(at + 1, len(runs) - 1):
        found += runs[k][1] != runs[at][1]
        if found >= SIDE:
            return True
    return False


def _settled_before(runs: deque, done: int) -> bool:
    """Whether the first run is no longer needed by those not finished: SIDE differing runs follow it before each of them."""
    for at in range(done, len(runs)):
        found = sum(runs[k][1] != runs[at][1] for k in range(1, at))
        if found < SIDE:
            return False
    return True
