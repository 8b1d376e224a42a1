"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts. Texts that stand on LITERAL_SHARE of all different pages of a host (three at least) are literals, all others one symbol. Streams are folded (tandem
repeats become repeated groups), and a host's different folded streams are aligned with its wrapper one after the other: where they agree a token stays as it is, where they differ
it becomes optional. The wrapper is then a regular expression over fixed tags, literals, text slots, (...)+ and (...)?. What is constant over a host is its template: literals
are no main text, but inside an article that the page marks by a tag. Slots that vary are main text unless tags put them outside the article, or, where nothing marks the
article, they are menus (blocks of links alone, side by side or in lists). Main slots are marked as spans; a page is matched by its host's wrapper
and the text of the main spans is its main text. Pages that a wrapper does not match in full are read by the same rules and by the host's literals, text by text.

A class word alone takes nothing out of a marked article unless it names adverts, comments or page parts (STRICT); others (LOOSE) need a second sign there: links alone, or literals alone.

Nothing is sampled. Texts are counted exactly over all different pages of a host (copies, pages of one main text, count once), by 64-bit hashes, and every folded stream goes into a wrapper: a host of more than
about TOGETHER different streams has several wrappers, streams dealt among them by hash, and a page is read by the one that its own stream went into, so no host lies in one task. Streams of more than MAX_TOKENS tokens
make no wrapper; their pages are read whole, by the rules and the host's literals. `matched` tells which pages a wrapper matched. Wrappers are broadcast while they are small, else joined, in joins whose partitions Spark can split.

Defined results: null or empty html gives an empty text; a null URL's host is the empty string; repeated pages and ids each get their own result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import cut, map_batches

#: Different streams that are aligned in one wrapper, about.
TOGETHER = 12
#: Longest folded stream that wrappers are made from; longer pages are still read.
MAX_TOKENS = 4000
#: Share of a host's different pages that a literal stands on, and the least share of the main text that must be left when literals are taken out (else the pages are copies).
LITERAL_SHARE, LEFT_SHARE = 0.6, 0.2
BROADCAST_BYTES = 16 << 20
#: Up to so many hosts and hashes of pages, one for each stream, are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 200_000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
OUTSIDE = frozenset("nav footer aside form head title menu dialog".split())
MAIN = frozenset("article main".split())
#: Words of a class, id or role that name what is no article. Words stand alone or with words for a kind of box.
_BOX = r"(?:^|\s)(?:(?:site|page|top|left|right|post|entry|user|main)[_-])?(?:%s)(?:[_-](?:box|block|list|bar|container|wrapper|wrap|section|area|widget|links?|buttons?|icons?|form|top|bottom|left|right|inner|content|unit|slot|\d+))*(?=\s|$)"
STRICT = re.compile(_BOX % r"ads?|adverts?|advertis\w+|cookies?|consent|menu|navi?|navbar|navigation|breadcrumbs?|sidebar|footer|masthead|comments?|respond|replies|newsletter|subscribe|popup|modal|contentinfo|complementary", re.I)
LOOSE = re.compile(_BOX % r"banner|header|share|sharing|social|related|promo\w*|sponsor\w*|notices?|notification|alert|widget|disclaimer|search", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post-?(?:body|content)|entry-?content|story-?body|main-?content|content)(?:$|[\s_-])", re.I)
CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article footer nav aside header form blockquote pre".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "option": frozenset(["option"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, value): `<` opening tag with its class, id and role, `>` closing tag, `#` text that is not blank, `_` blank text. Comments, scripts and styles fall out."""
    out = []
    for m in TOKEN.finditer(page):
        name = m[3]
        if name:
            name = name.lower()
            if m[2]:
                out.append((">", name, ""))
            else:
                mark = " ".join(x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(m[4])) if "=" in m[4] else ""
                out.append(("<", name, mark))
                if m[4].endswith("/") and name not in VOID:
                    out.append((">", name, ""))
        elif m[1] is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                if out and out[-1][0] in "#_":  # parted by a comment or a bare <
                    t = out.pop()[2] + t
                out.append(("_" if t.isspace() else "#", "", t))
    return out


def names_main(toks: list[tuple[str, str, str]]) -> bool:
    """Whether some tag says that it holds the article."""
    return any(k == "<" and (n in MAIN or v and GOOD.search(v)) for k, n, v in toks)


def marks(toks: list[tuple[str, str, str]]) -> list[tuple[bool, bool, int]]:
    """For each token: whether it stands in a marked article, is shut out by its tags, and the number of the loose box around it (-1: none)."""
    stack: list[tuple[str, int, bool, int]] = []  # name, articles around, shut out, loose box
    inside, shut, box = 0, False, -1
    out = []
    for at, (k, n, v) in enumerate(toks):
        if k == "<":
            if n not in VOID:
                while stack and stack[-1][0] in CLOSED_BY and n in CLOSED_BY[stack[-1][0]]:
                    inside, shut, box = stack.pop()[1:]
                stack.append((n, inside, shut, box))
                named = bool(v) and n not in ("html", "body", "article", "main")
                marked = inside > 0
                inside += n in MAIN or bool(v and GOOD.search(v))
                shut = shut or n in OUTSIDE or n == "header" and not marked or named and bool(STRICT.search(v))
                if named and not shut and LOOSE.search(v):
                    shut, box = (shut, at) if marked else (True, box)
        elif k == ">":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == n:
                    _, inside, shut, box = stack[i]
                    del stack[i:]
                    break
                if stack[i][0] in MAIN or stack[i][0] == "body":
                    break
        out.append((inside > 0, shut, box))
    return out


def linked(toks: list[tuple[str, str, str]]) -> tuple[list[bool], list[bool]]:
    """For each token, whether it is a text in a link, and whether it is of a menu: blocks of links alone, in a list, of several links or beside another such block."""
    link, depth = [], 0
    blocks: list[tuple[list[int], bool]] = [([], False)]  # places of the texts, in a list item
    items = 0
    for at, (k, n, _) in enumerate(toks):
        if n == "a":
            depth = 1 if k == "<" else 0
        elif n == "li":
            items = max(items + (1 if k == "<" else -1), 0)
        if k in "<>" and n not in INLINE and blocks[-1][0]:
            blocks.append(([], False))
        link.append(k == "#" and depth > 0)
        if k == "#":
            blocks[-1] = (blocks[-1][0] + [at], items > 0)
    blocks = [b for b in blocks if b[0]]
    alone = [all(link[i] for i in b) for b, _ in blocks]
    menu = [False] * len(toks)
    for i, (b, item) in enumerate(blocks):
        if alone[i] and (item or len(b) > 1 or i and alone[i - 1] or i + 1 < len(alone) and alone[i + 1]):
            for at in b:
                menu[at] = True
    return link, menu


def roles(toks: list[tuple[str, str, str]], literal: list[bool] | None = None) -> list[bool]:
    """For each token, whether it is of the main text: by its own tags and, where given, by which texts are the host's template."""
    has_main, seen = names_main(toks), marks(toks)
    literal = literal or [False] * len(toks)
    link, menu = linked(toks)
    boxes: dict[int, bool] = {}  # a loose box goes if all its texts are links or all are literals
    for sign in (link, literal):
        own: dict[int, bool] = {}
        for (k, _, _), (_, _, box), x in zip(toks, seen, sign, strict=True):
            if k == "#" and box >= 0:
                own[box] = own.get(box, True) and x
        boxes = {b: boxes.get(b, False) or x for b, x in own.items()}
    if has_main:
        return [inside and not shut and not boxes.get(box, False) for inside, shut, box in seen]
    return [not (shut or menu[i] or literal[i]) for i, (_, shut, _) in enumerate(seen)]


TAG, CLOSE, UNIT, LITERAL = 0x20000, 0x30000, 0xF0000, 0x100000
#: Any literal, as a class of a regular expression.
ANY_LITERAL = "[\U00100000-\U0010ffff]"


def plain(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def signed(data: str) -> int:
    """A 64-bit hash as Spark's long."""
    import xxhash

    value = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def numbered(literals: Iterable[int]) -> dict[int, str]:
    """A symbol for each literal, given as hashes of plain texts."""
    return {t: chr(LITERAL + i % 0xFFFF) for i, t in enumerate(sorted(literals))}


def stream_key(toks: list[tuple[str, str, str]], literals: dict[int, str]) -> int | None:
    """A hash of the folded stream, its lowest bit whether a tag names the article; null where the stream is too long for wrappers."""
    symbols: dict[str, str] = {}
    units: dict[str, str] = {}
    folded = fold(shape(toks, symbols, literals, True), units)
    if len(folded) > MAX_TOKENS:
        return None
    return signed(json.dumps([folded, list(symbols), list(units)])) & ~1 | names_main(toks)


def shape(toks: list[tuple[str, str, str]], symbols: dict[str, str], literals: dict[int, str], grow: bool) -> str:
    """One character a token that is no blank text: opening and closing tags from TAG and CLOSE on, literals from LITERAL on, other texts `#`."""
    out = []
    for k, n, v in toks:
        if k == "#":
            out.append(literals.get(signed(plain(v)), "#") if literals else "#")
        elif k != "_":
            key = k + n + (" " + v if v else "")
            c = symbols.get(key)
            if c is None:
                c = "\uffff"
                if grow:
                    c = symbols[key] = chr((TAG if k == "<" else CLOSE) + len(symbols))
            out.append(c)
    return "".join(out)


TANDEM = re.compile("([\U00020000-\U0002ffff\U000f0000-\U000fffff].{0,63}?)\\1+")


def fold(s: str, units: dict[str, str]) -> str:
    """Tandem repeats become one character for their unit; known units fold where they stand once, too."""
    while True:
        before = s
        for unit, c in units.items():
            if unit in s:
                s = re.sub(f"(?:{re.escape(unit)}|{c})+", c, s)

        def group(m: re.Match) -> str:
            unit = m[1]
            if len(unit) == 1 and ord(unit) >= UNIT:
                return unit
            if unit not in units:
                units[unit] = chr(UNIT + len(units))
            return units[unit]

        s = TANDEM.sub(group, s)
        if s == before:
            return s


def align(wrapper: list[tuple[str, int]], s: str, next_group: int) -> tuple[list[tuple[str, int]], int]:
    """Elements (token, group), group 0 fixed, else optional together with its neighbours of one group; s is the next page's folded stream."""
    chars = "".join(c for c, _ in wrapper)
    out: list[tuple[str, int]] = []
    for op, a, b, i, j in SequenceMatcher(None, chars, s, autojunk=False).get_opcodes():
        if op == "equal":
            out += wrapper[a:b]
            continue
        for _, run in _runs(wrapper[a:b]):
            next_group += 1
            out += [(c, next_group) for c, _ in run]
        if j > i:
            next_group += 1
            out += [(c, next_group) for c in s[i:j]]
    return out, next_group


def _runs(elements: list[tuple[str, int]]):
    start = 0
    for i in range(1, len(elements) + 1):
        if i == len(elements) or elements[i][1] != elements[start][1]:
            yield elements[start][1], elements[start:i]
            start = i


def template_texts(pages: list[list[tuple[str, str, str]]]) -> list[str]:
    """Texts that are the template of a host's different pages; none where too few pages differ or too little text would be left."""
    if len(pages) < 3:
        return []
    need = max(3, math.ceil(LITERAL_SHARE * len(pages)))
    on = Counter(t for toks in pages for t in {plain(v) for k, _, v in toks if k == "#"} if t)
    found = {t for t, n in on.items() if n >= need}
    before = after = 0
    for toks in pages:
        own = [plain(v) in found for _, _, v in toks]
        before += sum(len(v) for (_, _, v), keep in zip(toks, roles(toks), strict=True) if keep)
        after += sum(len(v) for (_, _, v), keep in zip(toks, roles(toks, own), strict=True) if keep)
    return sorted(found) if after >= LEFT_SHARE * before else []


def infer(pages: list[str], known: Iterable[int] | None = None) -> dict | None:
    """The wrapper of pages of a host: symbols, literals (hashes), the regular expression with groups m0, m1, ... for main spans, and mixed: whether a repeated group holds both main text and literals.

    known: the host's literals; where they aren't given they are those of these pages."""
    symbols: dict[str, str] = {}
    units: dict[str, str] = {}
    read = [toks for p in pages if (toks := tokens(p))]
    if known is None:
        by_text: dict[str, list[tuple[str, str, str]]] = {}
        for toks in read:  # one page for each main text
            by_text.setdefault(render(toks, roles(toks)), toks)
        read = list(by_text.values())
        known = map(signed, template_texts(read))
    literals = numbered(known)
    streams = []
    for toks in read:
        s = shape(toks, symbols, literals, True)
        if len(fold(s, units)) <= MAX_TOKENS:
            streams.append(s)
    if not streams:
        return None
    wrapper, group = [(c, 0) for c in fold(streams[0], units)], 0  # all units are known by now, so that a group that a page has once is folded there as well
    for s in streams[1:]:
        wrapper, group = align(wrapper, fold(s, units), group)
    unit_of = {c: u for u, c in units.items()}
    names = {c: k for k, c in symbols.items()}

    def spread(c: str) -> str:
        return "".join(map(spread, unit_of[c])) if c in unit_of else c

    # roles of the wrapper's own slots
    flat = [spread(c) for c, _ in wrapper]
    fake, fixed = [], []
    for c in "".join(flat):
        key = names.get(c, "#")
        fake.append(("#", "", "x") if key == "#" else (key[0], *(key[1:].split(" ", 1) + [""])[:2]))
        fixed.append(ord(c) >= LITERAL)
    main, at, role, mixed = roles(fake, fixed), 0, [], False
    for part in flat:
        own = {main[at + i] for i, c in enumerate(part) if c == "#" or ord(c) >= LITERAL}
        role.append((True in own) if own else None)
        mixed = mixed or len(own) > 1
        at += len(part)
    last = None
    for i, r in enumerate(role):  # tags go with the span they stand in
        role[i] = last = r if r is not None else last
    first = next((r for r in role if r is not None), False)
    role = [first if r is None else r for r in role]

    def expression(c: str) -> str:
        if c in unit_of:
            return "(?:" + "".join(map(expression, unit_of[c])) + ")++"
        return ANY_LITERAL if ord(c) >= LITERAL else re.escape(c)

    out, n, open_ = [], 0, False
    for g, run in _runs([(c, (grp, r)) for (c, grp), r in zip(wrapper, role, strict=True)]):
        if g[1] and not open_:
            out.append(f"(?P<m{n}>")
            n, open_ = n + 1, True
        elif not g[1] and open_:
            out.append(")")
            open_ = False
        body = "".join(expression(c) for c, _ in run)
        out.append(f"(?:{body})?" if g[0] else body)
    if open_:
        out.append(")")
    return {"symbols": symbols, "literals": sorted(literals), "regex": "".join(out), "spans": n, "pages": len(streams), "main": names_main(fake), "mixed": mixed}


def render(toks: list[tuple[str, str, str]], main: list[bool]) -> str:
    """Main texts, blocks parted by \\n, white space inside a block as one space."""
    blocks, part = [], []
    for (k, n, v), keep in zip(toks, main, strict=True):
        if k in "#_":
            if keep:
                part.append(v)
        elif n not in INLINE:
            if part:
                blocks.append("".join(part))
                part = []
        elif n == "br" and keep:
            part.append(" ")
    blocks.append("".join(part))
    out = (" ".join(_html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in out if b)


class Reader:
    """Applies wrappers (JSON) to pages; compiled ones are kept while there are few."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def __call__(self, page: str | None, wrapper: str | None) -> tuple[str, bool]:
        """The main text, and whether the wrapper matched."""
        if not page:
            return "", False
        toks = tokens(page)
        if not wrapper:
            return render(toks, roles(toks)), False
        if wrapper not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            w = json.loads(wrapper)
            self.known[wrapper] = (w["symbols"], numbered(w["literals"]), re.compile(w["regex"], re.S), w["spans"], w["main"], w["mixed"]) if "regex" in w else ({}, numbered(w["literals"]), None, 0, False, False)
        symbols, literals, regex, n, with_main, mixed = self.known[wrapper]
        m = regex.fullmatch(shape(toks, symbols, literals, False)) if regex and with_main == names_main(toks) else None
        own = [k == "#" and signed(plain(v)) in literals for k, _, v in toks] if literals and (mixed or not m) else None
        if not m or mixed:
            alone = roles(toks, own)
            if not m:
                return render(toks, alone), False
        spans = [m.span(f"m{i}") for i in range(n) if m[f"m{i}"]]
        main, at, j = [], -1, 0
        for k, _, _ in toks:
            at += k != "_"
            while j < len(spans) and at >= spans[j][1]:
                j += 1
            main.append(j < len(spans) and spans[j][0] <= at)
        if mixed and own:  # literals of repeated groups
            main = [a and (b or not c) for a, b, c in zip(main, alone, own, strict=True)]
        return render(toks, main), True


def sent(df: DataFrame, literals: bool = False) -> DataFrame:
    """A table by host for a join: broadcast while it is small."""
    most, size = F.count(F.lit(1)), F.sum(F.octet_length("host") + 8 * F.greatest(F.size("literals"), F.lit(0))) if literals else F.lit(0)
    rows, total = df.agg(most, size).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def templates(pages: DataFrame) -> DataFrame:
    """host and literals (hashes) of hosts that have some: texts on LITERAL_SHARE of all different pages, three at least. pages has host, html and place, a hash of html."""

    def run(batch: pa.RecordBatch) -> dict:
        main, texts = [], []
        for html in batch.column("html").to_pylist():
            toks = tokens(html)
            main.append(signed(render(toks, roles(toks))))
            texts.append([signed(t) for t in {plain(v) for k, _, v in toks if k == "#"} if t])
        return {"host": batch.column("host"), "place": batch.column("place"), "main": main, "texts": texts}

    seen = map_batches(pages.select("host", "place", "html"), run, "host string, place long, main long, texts array<long>")
    # one page for each main text: that of the least hash
    different = cut(seen.groupBy("host", "main").agg(F.min(F.struct("place", "texts"))["texts"].alias("texts")))
    need = F.greatest(F.lit(3), F.ceil(F.lit(LITERAL_SHARE) * F.col("n"))).alias("need")
    hosts = cut(different.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("host", need))
    on = different.select("host", F.explode("texts").alias("t")).groupBy("host", "t").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3")
    return on.join(sent(hosts), "host").filter("c >= need").groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("literals"))


def surveyed(pages: DataFrame, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """host, literals (none where too little text would be left without them: the pages are copies) and n (wrappers) of every host; and host, part (wrapper) and place of a page for each different stream."""
    known = pages.filter("html is not null and html <> ''").select("host", "html", F.xxhash64("html").alias("place"))
    found = cut(templates(known))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"host": batch.column("host"), "place": batch.column("place"), "main": [], "before": [], "after": [], "bare": [], "full": []}
        for html, literals in zip(batch.column("html").to_pylist(), batch.column("literals").to_pylist(), strict=True):
            toks, chars = tokens(html), numbered(literals or [])
            alone = roles(toks)
            out["main"].append(signed(render(toks, alone)))
            out["bare"].append(stream_key(toks, {}))
            out["before"].append(sum(len(v) for (_, _, v), keep in zip(toks, alone, strict=True) if keep))
            if chars:
                own = [signed(plain(v)) in chars for _, _, v in toks]
                out["after"].append(sum(len(v) for (_, _, v), keep in zip(toks, roles(toks, own), strict=True) if keep))
            else:
                out["after"].append(out["before"][-1])
            out["full"].append(stream_key(toks, chars) if chars else out["bare"][-1])
        return out

    rows = cut(map_batches(known.join(sent(found, True), "host", "left").select("host", "place", "html", "literals"), run, "host string, place long, main long, before long, after long, bare long, full long"))
    different = rows.groupBy("host", "main").agg(F.min(F.struct("place", "before", "after")).alias("x"))
    shown = cut(different.groupBy("host").agg((F.sum("x.after") >= F.lit(LEFT_SHARE) * F.sum("x.before")).alias("shown")))
    keyed = rows.join(sent(shown), "host").select("host", "place", F.when(F.col("shown"), F.col("full")).otherwise(F.col("bare")).alias("key"))
    streams = cut(keyed.filter("key is not null").groupBy("host", "key").agg(F.min("place").alias("place")))
    n = streams.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / F.lit(together)).cast("long").alias("n"))
    hosts = shown.join(n, "host", "left").join(found, "host", "left")
    hosts = cut(hosts.select("host", F.when(F.col("shown"), F.col("literals")).alias("literals"), F.coalesce("n", F.lit(1)).alias("n")))
    part = (F.pmod(F.shiftright("key", 1), F.col("n")) * 2 + F.pmod("key", F.lit(2))).alias("part")
    return hosts, cut(streams.join(sent(hosts.select("host", "n")), "host").select("host", part, "place"))


def part_of(toks: list[tuple[str, str, str]], literals: dict[int, str], n: int) -> int | None:
    """The wrapper of a page among its host's."""
    key = stream_key(toks, literals)
    return None if key is None else (key >> 1) % n * 2 + key % 2


def wrappers(pages: DataFrame, hosts: DataFrame, streams: DataFrame) -> DataFrame:
    """host, part and wrapper (JSON); pages has host and html. Only the html of one page for each different stream is fetched."""
    known = pages.filter("html is not null and html <> ''").select("host", "html", F.xxhash64("html").alias("place"))
    chosen = F.broadcast(streams) if streams.count() <= BROADCAST_ROWS else streams
    fetched = known.join(chosen, ["host", "place"]).groupBy("host", "part", "place").agg(F.first("html").alias("html")).join(sent(hosts.select("host", "literals"), True), "host")

    def run(key, table):  # no type hints: Spark would read them
        found = infer(sorted(set(table.column("html").to_pylist())), table.column("literals")[0].as_py() or [])
        return pa.table({"host": [key[0].as_py()], "part": [key[1].as_py()], "wrapper": [json.dumps(found) if found else None]}, schema=pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())]))

    return fetched.groupBy("host", "part").applyInArrow(run, "host string, part long, wrapper string").filter("wrapper is not null")


def extract(pages: DataFrame, together: int = TOGETHER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars and matched (by a wrapper of its host) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    p = pages.select("page_id", "url", "html").withColumn("host", host)
    hosts, streams = surveyed(p, together)
    made = cut(wrappers(p, hosts, streams))
    size = (made.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) + (hosts.agg(F.sum(F.octet_length("host") + 8 * F.greatest(F.size("literals"), F.lit(0)) + 8)).first()[0] or 0)
    held = None
    if size <= broadcast_bytes:
        by_host = {r["host"]: (r["literals"] or [], r["n"], {}) for r in hosts.collect()}
        for r in made.collect():
            by_host[r["host"]][2][r["part"]] = r["wrapper"]
        held = pages.sparkSession.sparkContext.broadcast(by_host)
    state: dict = {}
    kind = dict(pages.dtypes)["page_id"]

    def bare(literals: list[int]) -> str | None:
        return json.dumps({"literals": literals}) if literals else None

    def part(page: str | None, literals: list[int], n: int | None) -> int | None:
        return part_of(tokens(page), numbered(literals), n) if page and n else None

    def parts(batch: pa.RecordBatch) -> dict:
        literals, n = batch.column("literals").to_pylist(), batch.column("n").to_pylist()
        got = [part(h, t or [], k) for h, t, k in zip(batch.column("html").to_pylist(), literals, n, strict=True)]
        return {**{c: batch.column(c) for c in ("page_id", "url", "html", "host")}, "bare": [bare(t or []) for t in literals], "part": got}

    def run(batch: pa.RecordBatch) -> dict:
        read = state.setdefault("read", Reader())
        html = batch.column("html").to_pylist()
        if held:
            own = []
            for h, page in zip(batch.column("host").to_pylist(), html, strict=True):
                literals, n, of = held.value.get(h, ([], None, {}))
                own.append(of.get(part(page, literals, n)) or bare(literals))
        else:
            own = [w or b for w, b in zip(batch.column("wrapper").to_pylist(), batch.column("bare").to_pylist(), strict=True)]
        got = [read(h, w) for h, w in zip(html, own, strict=True)]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": [t for t, _ in got], "n_chars": [len(t) for t, _ in got], "matched": [m for _, m in got]}

    if held:
        rows = p
    else:
        rows = map_batches(p.join(hosts, "host", "left").select("page_id", "url", "html", "host", "literals", "n"), parts, f"page_id {kind}, url string, html string, host string, bare string, part long").join(made, ["host", "part"], "left")
    return map_batches(rows.select("page_id", "url", "html", *(["host"] if held else ["wrapper", "bare"])), run, f"page_id {kind}, url string, text string, n_chars long, matched boolean")
