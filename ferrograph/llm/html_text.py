"""Main text of web pages by a tree-structured graphical model (operator 2).

Every block-level element of a page is a node with a hidden label, content or not. A node's own features (tag, words in
its class and id, length and link share of its text) give its potential, parent and child share a potential, and
sum-product messages up and then down the tree give each node's marginal. The weights are fitted by gradient ascent on
the likelihood of labelled pages, which `labelled_pages` writes from seeded layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import cache

from pyspark.sql import DataFrame

from .shared import per_text

# HTML's block-level elements, those whose text is never shown, those that hold no text, and what ends what.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video datalist title".split())
RAW = frozenset("script style iframe noscript title textarea".split())
ENDED_BY = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SAME = {"dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}}
SECTIONS = frozenset("article aside footer form header main nav section fieldset menu".split())
# Words that page authors use in class and id attributes, by what they mark.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc topbar toolbar sitemap",
    "frame": "header masthead banner footer foot copyright legal colophon branding logo",
    "side": "sidebar side aside widget rail related recommended popular trending tags teaser more",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast warning privacy paywall",
    "form": "form search login signup signin subscribe subscription newsletter register contact",
    "talk": "comment comments reply replies discussion disqus respond thread feedback review reviews",
    "share": "share sharing social follow twitter facebook byline meta author date",
    "text": "article content main post entry story body text prose copy page",
}
# The same in German, French and Spanish.
FOREIGN = {
    "menu": "navigation navigationsleiste menue menú menu brotkrumen fil-ariane migas",
    "frame": "kopfzeile fusszeile fußzeile impressum entête entete pied cabecera pie",
    "side": "seitenleiste randspalte verwandt barre laterale connexe lateral barra relacionados",
    "advert": "werbung anzeige reklame publicité publicite pub publicidad anuncio",
    "notice": "hinweis einwilligung datenschutz avis consentement aviso consentimiento",
    "form": "suche anmeldung formular recherche connexion formulaire buscar acceso formulario",
    "talk": "kommentar kommentare antworten commentaire commentaires réponse comentario comentarios respuestas",
    "share": "teilen folgen autor partager suivre auteur compartir seguir",
    "text": "artikel inhalt beitrag texte contenu artículo contenido",
}
# Words that head parts which are not the article, and that notices hold.
HEADS = {
    "talk": r"(?:\d+\s+)?(?:comments?|replies|responses|discussion|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas)(?:\s*\(?\d+\)?)?:?|leave a (?:reply|comment)|post a comment|join the discussion|what do you think\??",
    "side": r"related(?: \w+)?|recommended(?: \w+)?|popular(?: \w+)?|most read|trending(?: \w+)?|more (?:from|stories|articles|news)\b.*|read (?:more|next)|you (?:may|might) (?:also )?like|see also|tags|archives?|categories",
    "share": r"share(?: this(?: \w+)?)?|follow us|teilen|partager|compartir",
    "form": r"subscribe\b.*|newsletter|sign up\b.*|log ?in|search|contact us",
}
SAYS = {"notice": r"\bcookies?\b|\bconsent\b|\bGDPR\b|\bDatenschutz\b", "frame": r"©|\ball rights reserved\b|\bcopyright\b"}
HINT_OF = {w: kind for table in (FOREIGN, HINTS) for kind, words in table.items() for w in words.split()}
STEMS = re.compile("|".join(sorted((w for w in HINT_OF if len(w) > 4 and w.isalpha()), key=len, reverse=True)))
HEAD_OF = re.compile("|".join(f"(?P<{k}>{p})" for k, p in HEADS.items()), re.I)
SAID = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SAYS.items()), re.I)

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?>[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)|</[^>]*>|<|[^<]+",
    re.S,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE_WORD = re.compile(r"[^\W\d_]+(?:-ad\b)?")
UNSHOWN = re.compile(r"(?:^|\s)hidden(?=$|[\s/=])|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*)\bdisplay\s*:\s*none", re.I)
LEVELS = {f"h{k}": k for k in range(1, 7)}
PROSE = frozenset(["p", "blockquote", "pre", "td", *LEVELS])


class Node:
    __slots__ = ("parent", "tag", "kinds", "runs", "chars", "linked", "last", "first", "controls", "under", "shown", "inside")

    def __init__(self, parent: int, tag: str, kinds: frozenset):
        self.parent, self.tag, self.kinds, self.runs, self.chars, self.linked, self.last = parent, tag, kinds, [], 0, 0, ""
        self.first, self.controls, self.under, self.shown, self.inside = "", 0, "", True, False


@cache
def hints(rest: str) -> frozenset:
    """What the attributes say of an element: kinds of the words in class, id and role, or of known words inside them."""
    found = set()
    for m in NAMED.finditer(rest):
        for word in ATTRIBUTE_WORD.findall((m[1] or m[2] or m[3] or "").lower()):
            if kind := HINT_OF.get(word):
                found.add(kind)
            elif inner := STEMS.search(word):
                found.add(HINT_OF[inner[0]])
    return frozenset(found)


def parse(page: str) -> list[Node]:
    """The page's block elements, parents first; node 0 is the page itself. A run is [place in the page, text]. Linear in the page."""
    nodes, stack, place, links = [Node(-1, "page", frozenset())], [0], 0, 0
    depths: dict[str, list[int]] = {}  # where in the stack elements of a tag are open
    endless: set[str] = set()  # hidden elements that nothing ends any more
    run: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal run, linked, place
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            node = nodes[stack[-1]]
            if text and node.shown:
                node.runs.append((place, text))
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.first, node.last = node.first or text, text[-1]
                place += 1
            run, linked = [], 0

    def leave(depth: int) -> None:
        while len(stack) > depth:
            depths[nodes[stack.pop()].tag].pop()

    def last_open(tags: set[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    at, size = 0, len(page)
    while at < size:
        m = PIECE.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if page[m.start()] != "<" or m[0] == "<":
                run.append(m[0])
                if links:
                    linked += len(m[0].strip())
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if depth := last_open({tag}):
                    close()
                    leave(depth)
                    links = 0
            elif tag == "br":
                run.append(" ")
            continue
        if tag in HIDDEN or tag in RAW:
            if not m["rest"].endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{tag}[^>]*>|\Z", re.I).search(page, at)
                    at = end.end()
                elif tag not in endless:
                    end = re.compile(rf"</{tag}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, at)
                    if end:
                        at = end.end()
                    else:
                        endless.add(tag)
            continue
        if tag in ("input", "button", "select", "textarea"):
            nodes[stack[-1]].controls += 1
        if tag == "a":
            links += 1
        elif tag in ("br", "wbr", "img", "input"):
            run.append(" " if tag != "wbr" else "")
        elif tag in BLOCKS:
            close()
            links = 0
            if nodes[stack[-1]].tag == "p":
                leave(len(stack) - 1)
            if bounds := ENDED_BY.get(tag):
                same = last_open(SAME.get(tag, {tag}))
                if same > last_open(bounds):
                    leave(same)
            nodes.append(Node(stack[-1], tag, hints(m["rest"]) if m["rest"] else frozenset()))
            nodes[-1].shown = nodes[stack[-1]].shown and not (m["rest"] and UNSHOWN.search(m["rest"]))
            nodes[-1].inside = nodes[stack[-1]].inside or nodes[stack[-1]].tag in ("article", "main")
            if tag != "hr":
                depths.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
    close()
    headed(nodes)
    return nodes


def headed(nodes: list[Node]) -> None:
    """Mark what a telling heading heads: later elements of its parent, up to a heading as high, and the parent if it begins with it."""
    now: dict[int, tuple[int, str]] = {}  # by parent: level and kind of the last heading
    begun: set[int] = set()
    for node in nodes[1:]:
        level = LEVELS.get(node.tag, 0)
        if level or (node.chars and node.chars < 40 and node.tag in ("summary", "legend", "dt", "p", "div")):
            m = HEAD_OF.fullmatch(node.first.strip(" :")) if node.chars < 60 else None
            before = now.get(node.parent)
            if m:
                now[node.parent] = (level or 6, m.lastgroup)
                node.under = m.lastgroup
                if node.parent not in begun and node.parent > 0 and nodes[node.parent].tag not in ("body", "article", "main"):
                    nodes[node.parent].under = m.lastgroup
            elif level and before and level <= before[0]:
                del now[node.parent]
        elif node.parent in now:
            node.under = now[node.parent][1]
        if node.parent in now and not node.under:
            node.under = now[node.parent][1]
        begun.add(node.parent)


def headed_by(node: Node) -> str:
    """What the heading above says of the node; nothing if the node is an article's own piece of text, as sections of articles have such names too."""
    own = node.inside and node.tag in PROSE and node.chars and node.linked * 2 <= node.chars and not node.kinds and not node.controls
    return "" if own else node.under


def features(node: Node) -> list[str]:
    found = [f"tag {node.tag}", *(f"hint {k}" for k in node.kinds)]
    if under := headed_by(node):
        found.append(f"under {under}")
    if node.controls:
        found.append("holds controls")
    if node.chars:
        size = "short" if node.chars < 30 else "middle" if node.chars < 100 else "long"
        share = node.linked / node.chars
        found += [f"text {size} {'linked' if share > 0.5 else 'some' if share > 0.2 else 'plain'}"]
        if node.chars < 400 and (said := {m.lastgroup for _, run in node.runs for m in SAID.finditer(run)}):
            found += [f"says {k} {'inside' if node.inside else 'marked' if node.kinds or node.controls else 'plain'}" for k in said]
        if node.last in ".!?…:;\"'”»)":
            found.append("ends as a sentence")
        if node.tag in ("page", "html", "body"):
            found.append(f"bare {size}")
    else:
        found.append("holds no text")
    return found


#: Kinds of parent-child pairs, each with a potential of its own for equal and for differing labels.
def pair(parent: Node, child: Node) -> str:
    marked = "headed" if headed_by(child) else "marked" if (child.kinds - {"text"}) or child.tag in SECTIONS - {"article", "main"} else "text" if child.chars else "box"
    if parent.parent <= 0 and parent.tag in ("page", "body"):
        return f"page {marked}"
    return f"{'article' if parent.tag in ('article', 'main') or parent.kinds == {'text'} else 'section' if parent.kinds or parent.tag in SECTIONS else 'inside'} {marked}"


def marginals(nodes: list[Node], weights: dict[str, float]) -> tuple[list[float], list[tuple]]:
    """P(content) of each node, and for each edge the joint of (parent, child) as (p00, p01, p10, p11), by two passes of messages."""
    n = len(nodes)
    below = [[0.0, 0.0] for _ in range(n)]
    edge: list = [None] * n
    up: list = [None] * n
    exp, log = math.exp, math.log
    # the page itself is content only if text stands in no block at all
    below[0][1] += sum(weights.get(f, 0.0) for f in features(nodes[0])) if nodes[0].runs else -1e9
    for i in range(n - 1, 0, -1):
        node, own = nodes[i], below[i]
        own[1] += sum(weights.get(f, 0.0) for f in features(node))
        kind = pair(nodes[node.parent], node)
        edge[i] = tuple(weights.get(f"pair {kind} {a}{b}", 0.0) for a in (0, 1) for b in (0, 1))
        t = edge[i]
        up[i] = []
        for a in (0, 1):
            x, y = t[2 * a] + own[0], t[2 * a + 1] + own[1]
            top = x if x > y else y
            up[i].append(top + log(exp(x - top) + exp(y - top)))
        parent = below[node.parent]
        parent[0] += up[i][0]
        parent[1] += up[i][1]
    total = [list(b) for b in below]
    joint: list[tuple] = [()] * n
    for i in range(1, n):
        rest = [total[nodes[i].parent][a] - up[i][a] for a in (0, 1)]
        t, own = edge[i], below[i]
        score = [rest[a] + t[2 * a + b] + own[b] for a in (0, 1) for b in (0, 1)]
        top = max(score)
        score = [exp(s - top) for s in score]
        z = sum(score)
        joint[i] = tuple(s / z for s in score)
        for b in (0, 1):
            s = score[b] + score[2 + b]
            total[i][b] = log(s) if s > 0 else -1e9
    odds = total[0][1] - total[0][0]
    return [1 / (1 + exp(-odds)) if odds > -700 else 0.0] + [j[1] + j[3] for j in joint[1:]], joint


def labelled_pages(count: int, seed: int, names: bool = True) -> list[tuple[str, str]]:
    """Pages of varied layouts beside their main text. Articles have sections and sentences with the words of menus and notices, too; without `names`, classes and ids are words that say nothing."""
    r = random.Random(seed)
    syllables = "ka lo mi ren tas vo shi un ble dor a en is que".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    say = lambda low, high: " ".join(word() for _ in range(r.randint(low, high)))
    sentence = lambda: " ".join(say(2, 18).capitalize() + r.choice([".", ".", ".", "?", ", " + say(2, 4) + "."]) for _ in range(r.choice([1, 1, 2, 3, 4, 5])))
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    known = lambda kind: r.choice((HINTS if r.random() < 0.8 else FOREIGN)[kind].split())
    # a tenth of the names are words that no list holds
    named = lambda kind: f' {r.choice(["class", "id"])}="{known(kind) if names and r.random() < 0.9 else word()}{r.choice(["", "-" + word(), " " + word(), word()])}"'
    heads = {"talk": ["Comments", "3 Comments", "Leave a reply", "Kommentare", "Commentaires"], "side": ["Related", "Popular posts", "More from here", "See also"], "share": ["Share", "Follow us"], "form": ["Newsletter", "Subscribe now"]}
    # Headings that articles have as other parts of pages do, and words of notices in plain sentences.
    sections = ["Search", "Discussion", "Related work", "Comments", "Archives", "Contact us", "Tags", "Popular belief", "Share", "Responses", "More from the field", "Newsletter", "See also"]
    notices = ["cookies", "consent", "copyright", "©", "GDPR", "all rights reserved", "Datenschutz"]
    spoken = lambda: sentence() if r.random() < 0.93 else f"{say(1, 6).capitalize()} {r.choice(notices)} {say(1, 6)}{r.choice(['.', '.', ''])}"
    pages = []
    for _ in range(count):
        out: list[str] = []
        kept: list[str] = []

        def listed(tag: str = "ul", rows: tuple[int, int] = (2, 8)) -> str:
            return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(*rows))) + f"</{tag}>"

        def junk() -> str:
            kind = r.choice("menu frame side advert notice form talk share".split())
            tag = {"menu": "nav", "side": "aside", "form": "form", "frame": r.choice(["header", "footer"])}.get(kind, r.choice(["div", "section", "p"]))
            if r.random() < 0.6:
                tag = r.choice(["div", "div", "section"])
                attributes = named(kind)
            else:
                attributes = named(kind) if tag in ("div", "section", "p") or r.random() < 0.4 else ""
            inner = {
                "menu": listed, "frame": lambda: say(2, 6) + link() if r.random() < 0.5 else f"&copy; {say(1, 12)}.",
                "side": lambda: f"<h3>{r.choice(heads['side']) if r.random() < 0.5 else say(1, 3)}</h3>" + (listed() if r.random() < 0.6 else f"<p>{sentence()}</p>"),
                "advert": sentence, "notice": lambda: r.choice([sentence(), f"<p>{say(2, 6).capitalize()} cookies {say(2, 9)}.</p><button>{say(1, 2)}</button>"]),
                "form": lambda: f"<label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button>" + r.choice(["", f"<p>{sentence()}</p>", f"<select><option>{word()}<option>{word()}</select>"]),
                "talk": lambda: f"<h3>{r.choice(heads['talk']) if r.random() < 0.5 else say(1, 2)}</h3>" + "".join(f"<{t}{named('talk') if r.random() < 0.5 else ''}><p>{sentence()}</p></{t}>" for t in [r.choice(["div", "div", "li", "li", "article"])] for _ in range(r.randint(1, 4))),
                "share": lambda: " ".join(link() for _ in range(3)) if r.random() < 0.5 else say(2, 5),
            }[kind]()
            made = f"<{tag}{attributes}>{inner if tag != 'p' else re.sub('<[^>]*>', ' ', inner)}</{tag}>"
            if kind in heads and r.random() < 0.25:  # its name says nothing, its heading does
                made = f"<section{named('text') if r.random() < 0.1 else ''}><h{(k := r.randint(2, 4))}>{r.choice(heads[kind])}</h{k}>{re.sub('<h3>.*?</h3>', '', inner)}</section>"
            return made

        def part() -> str:
            kind = r.random()
            if kind < 0.7:
                text = spoken() if r.random() < 0.9 else say(1, 4)
                kept.append(text)
                return f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{text}"
            if kind < 0.73 and whole:  # in an article's own element
                head, text = r.choice(sections), spoken()
                kept.extend([head, text])
                return f"<h2>{head}</h2><p>{text}</p>"
            if kind < 0.8:
                text = say(2, 7)
                kept.append(text)
                return f"<h{(k := r.randint(2, 4))}>{text}</h{k}>"
            if kind < 0.87:
                rows = [sentence() if r.random() < 0.5 else say(3, 9) for _ in range(r.randint(2, 4))]
                kept.extend(rows)
                return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>"
            text = sentence()
            kept.append(text)
            tag = r.choice(["blockquote", "div", "figcaption", "pre", "td"])
            return {"td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}>{text}</{tag}>")

        for _ in range(r.randint(0, 3)):
            out.append(junk())
        tag, attributes = r.choice([("article", ""), ("article", ""), ("article", named("text")), ("main", ""), ("div", named("text")), ("div", named("text")), ("section", named("text")), ("div", ""), ("", "")])
        inside = []
        whole = tag in ("article", "main")
        if r.random() < 0.08:  # text in no block of its own
            lines = [spoken() for _ in range(r.randint(1, 6))]
            out.append((bare := r.choice(["<br>", "<br><br>", " <br/> "]).join(lines)))
            kept.append(" ".join(lines))
            out += [junk() for _ in range(r.choice([0, 0, 1, 2]))]
            pages.append((r.choice(["<html><head><title>x</title></head><body>{}</body></html>", "<body>{}</body>", "{}"]).format("".join(out)) if len(out) > 1 or r.random() < 0.7 else bare, " ".join(kept)))
            continue
        if r.random() < 0.8:
            kept.append(title := say(3, 10) if r.random() < 0.93 else f"{say(1, 3)} {r.choice(notices)} {say(0, 2)}".strip())
            inside.append(f"<h1>{title}</h1>")
        if r.random() < 0.3:
            first = sentence()
            kept.append(first)
            inside.append(f"<p><b>{first}<br>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 6, 9]) if inside else 2):
            inside.append(part())
            if r.random() < 0.1:
                inside.append(junk())
        body = f"<{tag}{attributes}>{''.join(inside)}</{tag}>" if tag else "".join(inside)
        out.append(r.choice([body, body, f"<div>{body}</div>", f"<main>{body}</main>"]))
        for _ in range(r.randint(0, 4)):
            out.append(junk())
        wrap = r.choice([("", ""), ("<div>", "</div>"), ('<div id="page">', "</div>")])
        pages.append((f"<!DOCTYPE html><html><head><title>{say(2, 5)}</title></head><body>{wrap[0]}{''.join(out)}{wrap[1]}</body></html>", " ".join(kept)))
    return pages


@cache
def trained(count: int = 1500, seed: int = 11, rounds: int = 10) -> dict[str, float]:
    """Weights by stochastic gradient ascent (each weight with a step of its own) on labelled pages."""
    data = []
    for page, text in labelled_pages(count, seed):
        nodes, at, truth = parse(page), 0, {}
        for _, i, run in sorted((place, i, run) for i, node in enumerate(nodes) for place, run in node.runs):
            hit = text.startswith(run, at)
            truth[i] = max(truth.get(i, 0), int(hit))
            at += (len(run) + 1) * hit
        for i in range(len(nodes) - 1, 0, -1):  # a container is content if most of what it holds is
            if i not in truth:
                below = [(truth.get(k, 0), len(nodes[k].runs)) for k in range(i + 1, len(nodes)) if nodes[k].parent == i]
                truth[i] = int(sum(y for y, _ in below) * 2 > len(below))
        data.append((nodes, [truth.get(0, 0), *(truth[i] for i in range(1, len(nodes)))]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(data)
        for nodes, truth in data:
            content, joint = marginals(nodes, weights)
            step: dict[str, float] = {f: truth[0] - content[0] for f in features(nodes[0])} if nodes[0].runs else {}
            for i in range(1, len(nodes)):
                for f in features(nodes[i]):
                    step[f] = step.get(f, 0.0) + truth[i] - content[i]
                kind, right = pair(nodes[nodes[i].parent], nodes[i]), 2 * truth[nodes[i].parent] + truth[i]
                for k in range(4):
                    f = f"pair {kind} {k >> 1}{k & 1}"
                    step[f] = step.get(f, 0.0) + (k == right) - joint[i][k]
            for f, g in step.items():
                g -= 0.002 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f] + 1e-8)
    return weights


def main_text(page: str, weights: dict[str, float]) -> str:
    nodes = parse(page)
    content, _ = marginals(nodes, weights)
    runs = [run for node, p in zip(nodes, content, strict=True) if p > 0.5 for run in node.runs]
    return " ".join(text for _, text in sorted(runs))


def extract_text(pages: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ("url",), html_column: str = "html") -> DataFrame:
    """Per page: key, the columns `keep`, text (main text, "" if none) and n_chars (its code points).

    Null and empty pages have no text. Repeated rows stay repeated; other columns are ignored. One pass over the pages,
    no shuffle; the weights (some hundred numbers) go with the task.
    """
    weights = trained()

    def work(texts: list[str]) -> list[list]:
        found = [main_text(t, weights) for t in texts]
        return [found, [len(t) for t in found]]

    return per_text(pages, [key, *keep], html_column, "text string, n_chars bigint", work)
