"""Markup residue in text documents: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text is read as one of four languages (told by marks that only one of them has; the stated type and the path only break
ties) and becomes a stream of tokens: heading, item, code, formula, text. Tags of HTML inside Markdown or wiki text are HTML
of their own. The stream is rendered as clean text; plain texts come out unchanged, byte for byte.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("html", "latex", "markdown", "wiki")
HEADING, ITEM, CODE, FORMULA, TEXT = "heading", "item", "code", "formula", "text"
#: The order of the counts of a language.
COUNTED = (HEADING, ITEM, CODE, FORMULA)

# fixed values: element names of HTML, and those that wiki text defines itself
HTML_TAGS = set(
    "a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark menu meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
WIKI_TAGS = set("math ref references nowiki syntaxhighlight source gallery poem includeonly noinclude onlyinclude timeline score chem ce templatestyles categorytree imagemap inputbox section".split())
BREAKS = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_ATTRIBUTES = r"(?:\s+(?:[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)|\s*/)*"
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(" + _ATTRIBUTES + r")\s*/?>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_UNSEEN = re.compile(r"<(script|style|head|template|noscript|title)\b" + _ATTRIBUTES + r"\s*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_TEX_MATH = re.compile(r"\$\$.+?\$\$|\\\[(?:(?!\\\[).)+?\\\]|\\\((?:(?!\\\().)+?\\\)", re.S)
_DISPLAY = re.compile(r"(?<!\\)\\\[(?:(?!\\\[).)+?\\\]|\\\((?:(?!\\\().)+?\\\)", re.S)
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]|\\.)+?)(?<![\s\\])\$(?![\w$])")


@dataclass
class Stream:
    """What a text is in one language: its tokens in order, and the lines in which tags of HTML were found."""

    language: str
    tokens: list[tuple[str, str, int]] = field(default_factory=list)  # kind, text, depth
    html: list[str] = field(default_factory=list)

    def add(self, kind: str, text: str, depth: int = 0) -> None:
        self.tokens.append((kind, text, depth))


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", text)


def _tags(text: str) -> list[str]:
    """Names of the HTML elements whose tags stand in a text."""
    return [n for n in (m[2].lower() for m in _TAG.finditer(text)) if n in HTML_TAGS]


# --- Markdown ---------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^`]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_BULLET = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])([ \t]+)(\S.*)$")
_INDENTED = re.compile(r"^(?: {4}| {0,3}\t)")
_LINK_LINE = re.compile(r"^ {0,3}\[[^\]\n]+\]:\s*\S+")
_MD_INLINE = re.compile(
    r"!?\[[^\[\]\n]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)|`[^`\n]+`|\*\*\*?[^\s*](?:[^*\n]*[^\s*])?\*\*\*?|(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])|~~[^\s~](?:[^~\n]*[^\s~])?~~|(?<!\w)_[^\s_](?:[^_\n]*[^\s_])?_(?!\w)|(?<!\w)__[^\s_][^_\n]*\s[^_\n]*[^\s_]__(?!\w)"
)


def markdown(text: str) -> Stream:
    out, lines, i = Stream("markdown"), lines_of(text), 0
    if lines and lines[0].strip() == "---":  # metadata
        end = next((j for j in range(1, len(lines)) if lines[j].strip() in ("---", "...")), None)
        if end and all(not x.strip() or re.match(r"^\s*(?:[\w.-]+:|- |#)|^\s+\S", x) for x in lines[1:end]):
            i = end + 1
    listed = above = False  # inside a list; the line above is text of a paragraph
    blank = True
    while i < len(lines):
        line = lines[i]
        i += 1
        if not line.strip():
            blank, above = True, False
            continue
        was_blank, blank = blank, False
        fence = _FENCE.match(line.lstrip() if listed else line)
        if fence:
            body = []
            while i < len(lines) and not re.match(r"^\s*" + re.escape(fence[1]) + fence[1][0] + r"*\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            out.add(CODE, "\n".join(body))
            above = False
            continue
        bullet = _BULLET.match(line)
        if _INDENTED.match(line) and not listed and (was_blank or not above):
            body = [line]
            while i < len(lines) and (not lines[i].strip() or _INDENTED.match(lines[i])):
                body.append(lines[i])
                i += 1
            while not body[-1].strip():
                body.pop()
                i -= 1
            out.add(CODE, "\n".join(_INDENTED.sub("", x) for x in body))
            above = False
            continue
        if above and _SETEXT.match(line):
            kind, was, _ = out.tokens.pop()
            while out.tokens and out.tokens[-1][0] == FORMULA and out.tokens[-1][2] < 0:
                out.add(*out.tokens.pop())  # formulas of the line keep their place after it
                break
            out.add(HEADING, was, 1 if line.strip()[0] == "=" else 2)
            above = False
            continue
        if _RULE.match(line):
            above = listed = False
            continue
        atx = _ATX.match(line)
        if atx:
            _md_line(out, HEADING, atx[2] or "", len(atx[1]))
            above = listed = False
            continue
        if line.strip().startswith("$$"):
            body = line.strip()
            while body.count("$$") < 2 and i < len(lines):
                body += "\n" + lines[i]
                i += 1
            out.add(FORMULA, body.strip().strip("$").strip())
            above = False
            continue
        if bullet and not (above and bullet[2][0].isdigit() and bullet[2][:-1] != "1"):
            _md_line(out, ITEM, bullet[4], len(bullet[1].expandtabs(4)) // 2)
            listed, above = True, False
            continue
        if _LINK_LINE.match(line) or re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*$", line):
            above = False
            continue
        if not line[0].isspace():
            listed = listed and not was_blank
        _md_line(out, TEXT, re.sub(r"^ {0,3}(?:> ?)+", "", line))
        above = not line.lstrip().startswith(("|", ">")) and not listed
    return out


def _md_line(out: Stream, kind: str, line: str, depth: int = 0) -> None:
    """A token for a line, before it one for each formula in it."""
    bare = re.sub(r"`[^`\n]+`", " ", line)
    for m in re.finditer(r"\$\$.+?\$\$", bare):
        out.add(FORMULA, m[0].strip("$").strip(), -1)
    for m in _DOLLAR.finditer(re.sub(r"\$\$.+?\$\$", " ", bare)):
        out.add(FORMULA, m[1], -1)
    if "<" in bare and _tags(bare):
        out.html.append(bare)
    out.add(kind, line, depth)


def _md_clean(line: str) -> str:
    line = re.sub(r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1", line)
    line = re.sub(r"(\*{1,3}|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", line)
    line = re.sub(r"(?<!\w)_(?=[^\s_])([^_\n]+?)(?<=\S)_(?!\w)", r"\1", line)
    line = _strip_tags(re.sub(r"`([^`\n]+)`", r"\1", line))
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", line)


# --- wiki text --------------------------------------------------------------------------------------------------------

_W_HEAD = re.compile(r"^(={1,6})\s*([^=\s].*?|[^=\s])\s*\1\s*$")
_W_LIST = re.compile(r"^([*#]+)[:;]*\s*(\S.*)$")
_W_CODE = re.compile(r"<(pre|syntaxhighlight|source)\b(" + _ATTRIBUTES + r")\s*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_W_MATH = re.compile(r"<(math|chem|ce)\b" + _ATTRIBUTES + r"\s*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_W_RAW = re.compile(r"<nowiki\s*>(.*?)(?:</nowiki\s*>|\Z)", re.S | re.I)
_W_INLINE = re.compile(r"\[\[[^\[\]\n]+\]\]|'''''?[^'\n]+?'''''?|''[^'\n]+?''|\{\{[^{}\n]+\}\}|\[https?://\S+[^\]\n]*\]|__(?:NOTOC|TOC|NOEDITSECTION)__")


def _hold(text: str, pattern: re.Pattern, kind: str, group: int, kept: list) -> str:
    """Whole constructs out of the text, each replaced by a mark (a control sign and its number)."""

    def keep(m):
        kept.append((kind, m[group]))
        return f"\x02{len(kept) - 1}\x03"

    return pattern.sub(keep, text)


_MARK = re.compile(r"\x02(\d+)\x03")


def _flow(out: Stream, kind: str, line: str, depth: int, kept: list) -> None:
    """A token for a line and one for each held construct, in order; a line that is nothing else gives no token of its own."""
    parts = _MARK.split(line)
    prose = "".join(x if i % 2 == 0 else kept[int(x)][1] if kept[int(x)][0] in (FORMULA, "raw") else "" for i, x in enumerate(parts))
    for x in parts[1::2]:
        if kept[int(x)][0] in (CODE, FORMULA):
            out.add(*kept[int(x)], -1 if kept[int(x)][0] == FORMULA and re.sub(r"[\s:]", "", _MARK.sub("", line)) else 0)
    if kind != TEXT or re.sub(r"[\s:;]", "", _MARK.sub("", line)) or any(kept[int(x)][0] == "raw" for x in parts[1::2]):
        out.add(kind, prose, depth)


def wiki(text: str) -> Stream:
    out, kept = Stream("wiki"), []
    body = _hold(_COMMENT.sub("", text.replace("\x02", "").replace("\x03", "")), _W_RAW, "raw", 1, kept)
    body = _hold(_hold(body, _W_CODE, CODE, 3, kept), _W_MATH, FORMULA, 2, kept)
    body = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)", "", body, flags=re.S | re.I)
    while re.search(r"\{\{[^{}]*\n[^{}]*\}\}", body):  # boxes of several lines are metadata
        body = re.sub(r"\{\{[^{}]*\n[^{}]*\}\}", "", body)
    for line in lines_of(body):
        head, item = _W_HEAD.match(line), _W_LIST.match(line)
        if "<" in line and any(t not in WIKI_TAGS for t in _tags(line)):
            out.html.append(line)
        if head:
            _flow(out, HEADING, head[2], len(head[1]), kept)
        elif item:
            _flow(out, ITEM, item[2], len(item[1]) - 1, kept)
        elif re.match(r"^\s*(?:\{\||\|\}|\|-)|^-{4,}\s*$|^\[\[(?:Category|Kategori\w*|Catégorie|Categoría):[^\]]*\]\]\s*$", line):
            continue
        elif line.strip():
            _flow(out, TEXT, re.sub(r"^[:;]+\s*", "", line), 0, kept)
    return out


def _wiki_clean(line: str) -> str:
    line = re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", line)
    line = re.sub(r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", line)
    return _strip_tags(re.sub(r"'{2,5}", "", re.sub(r"\[https?://\S+\s+([^\]]*)\]", r"\1", line)))


# --- LaTeX ------------------------------------------------------------------------------------------------------------

_T_COMMENT = re.compile(r"(?<!\\)%.*$", re.M)
_T_CODE = re.compile(r"\\begin\{(lstlisting|verbatim\*?|Verbatim|minted|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_T_MATH = re.compile(
    r"\\begin\{((?:equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign)\*?)\}(?P<a>.*?)(?:\\end\{\1\}|\Z)|\$\$(?P<b>.+?)\$\$|(?<!\\)\\\[(?P<c>(?:(?!\\\[).)+?)\\\]|\\\((?P<d>(?:(?!\\\().)+?)\\\)|(?<![\\$])\$(?!\$)(?P<e>(?:[^$\\]|\\.)+?)(?<!\\)\$(?!\$)", re.S
)
_T_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_T_ITEM = re.compile(r"\\item\b(?:\s*\[[^\]]*\])?")
_T_INLINE = re.compile(r"\\(?:emph|text(?:bf|it|tt|sc|sf|rm|sl|up|md)|underline|label|ref|eqref|pageref|autoref|cite\w*|footnote|href|url|caption|includegraphics|usepackage|documentclass|title|author|date|bibliography\w*|input|include)\*?\s*[\[{]|\{\\(?:it|bf|em|tt|sc|sl|rm|sf|itshape|bfseries|ttfamily)\b|\\(?:begin|end)\{\w+\*?\}|\\maketitle\b|\\tableofcontents\b")
_T_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def latex(text: str) -> Stream:
    out, kept = Stream("latex"), []
    body = _hold("\n".join(lines_of(text.replace("\x02", "").replace("\x03", ""))), _T_CODE, CODE, 2, kept)
    body = _T_COMMENT.sub("", body)

    def formula(m):
        kept.append((FORMULA, next(x for x in m.group("a", "b", "c", "d", "e") if x is not None).strip()))
        return f"\x02{len(kept) - 1}\x03"

    body = _T_MATH.sub(formula, body)
    if "\\begin{document}" in body:
        body = body.split("\\begin{document}", 1)[1]
    depth = at = 0
    kind, level = TEXT, 0
    cuts = re.compile(_T_HEAD.pattern + "|(?P<item>" + _T_ITEM.pattern + r")|(?P<begin>\\begin\{(?:itemize|enumerate|description|list|compactitem|inparaenum)\*?\}(?:\[[^\]\n]*\])?)|(?P<end>\\end\{(?:itemize|enumerate|description|list|compactitem|inparaenum)\*?\})|(?P<gap>\n\s*\n)")
    for m in [*cuts.finditer(body), None]:
        piece = body[at : m.start()] if m else body[at:]
        if kind == ITEM or piece.strip():
            _flow(out, kind, " ".join(piece.split()), level, kept)
        if not m:
            break
        at, kind, level = m.end(), TEXT, 0
        if m["item"]:
            kind, level = ITEM, max(depth - 1, 0)
        elif m["begin"]:
            depth += 1
        elif m["end"]:
            depth = max(depth - 1, 0)
        elif m[1]:
            _flow(out, HEADING, m[2].strip(), _T_LEVEL[m[1]], kept)
    return out


def _latex_clean(line: str) -> str:
    line = re.sub(r"\\(?:label|ref|eqref|pageref|autoref|cite\w*|footnote|title|author|date|documentclass|usepackage|input|include|bibliography\w*)\*?(?:\[[^\]]*\])*\{(?:[^{}]|\{[^{}]*\})*\}", "", line)
    for _ in range(4):
        line = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}|\{\\[A-Za-z]+\s*([^{}]*)\}", lambda m: m[1] if m[1] is not None else m[2], line)
    line = re.sub(r"\\(?:begin|end)\{[^}]*\}|\\\\|\\(?:hline|maketitle|noindent|par)\b", " ", line)
    return re.sub(r"\\([#$%&_{}])", r"\1", line.replace("~", " ").replace("---", "—").replace("--", "–")).strip()


# --- HTML -------------------------------------------------------------------------------------------------------------

_H_CODE = re.compile(r"<(pre|listing|xmp)\b" + _ATTRIBUTES + r"\s*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_H_MATH = re.compile(r"<math\b" + _ATTRIBUTES + r"\s*>(.*?)(?:</math\s*>|\Z)", re.S | re.I)


def _strip_tags(text: str) -> str:
    """Without the tags of HTML and wiki text, entities resolved."""
    return entities.unescape(_TAG.sub(lambda m: "" if m[2].lower() in HTML_TAGS | WIKI_TAGS else m[0], text))


def hypertext(text: str) -> Stream:
    out, kept = Stream("html"), []
    body = text.replace("\x02", "").replace("\x03", "")
    body = _hold(_COMMENT.sub("", body), _H_CODE, CODE, 2, kept)
    body = re.sub(r"<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", "", _UNSEEN.sub("", body), flags=re.I)
    body = _hold(_hold(body, _H_MATH, FORMULA, 1, kept), _TEX_MATH, FORMULA, 0, kept)
    at, kind, level, depth, piece = 0, TEXT, 0, 0, ""

    def close() -> None:
        nonlocal piece
        if kind != TEXT or piece.strip():
            _flow(out, kind, " ".join(piece.split()), level, kept)
        piece = ""

    for m in _TAG.finditer(body):
        name = m[2].lower()
        if name not in HTML_TAGS:
            continue
        piece += body[at : m.start()]
        at = m.end()
        if name not in BREAKS or name == "br":
            piece += " " if name == "br" else ""
            continue
        close()
        kind, level = TEXT, 0
        if name in ("ul", "ol"):
            depth = max(depth - 1, 0) if m[1] else depth + 1
        elif not m[1] and name == "li":
            kind, level = ITEM, max(depth - 1, 0)
        elif not m[1] and re.fullmatch(r"h[1-6]", name):
            kind, level = HEADING, int(name[1])
    piece += body[at:]
    close()
    out.tokens = [(k, entities.unescape(_strip_tags(t)) if k != TEXT else _strip_tags(t), d) for k, t, d in out.tokens]
    return out


# --- which language ---------------------------------------------------------------------------------------------------

_READERS = {"markdown": markdown, "wiki": wiki, "latex": latex, "html": hypertext}
_CLEAN = {"markdown": _md_clean, "wiki": _wiki_clean, "latex": _latex_clean, "html": lambda x: x}


def _count(pattern: str | re.Pattern, text: str, flags: int = re.M) -> int:
    return sum(1 for _ in (re.finditer(pattern, text, flags) if isinstance(pattern, str) else pattern.finditer(text)))


def _underlined(body: str) -> int:
    """Lines of text with a line of equals signs or hyphens below."""
    under = re.finditer(r"\n {0,3}(?:={3,}|-{3,})[ \t]*$", body, re.M)
    return sum(bool(body[body.rfind("\n", 0, m.start()) + 1 : m.start()].strip("=-| \t")) for m in under)


def marks(text: str) -> dict[str, int]:
    """How many marks of each language stand in a text, outside code and formulas, that no other of the four has."""
    plain = "\n".join(lines_of(text))
    fences = _count(r"^ {0,3}(?:```|~~~)", plain)
    body = re.sub(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*\s*$|\Z)", "\n", plain, flags=re.S | re.M)
    codes = len(_T_CODE.findall(body))
    body = _T_CODE.sub("\n", body)
    w_code = len([m for m in _W_CODE.finditer(body) if m[1].lower() != "pre"]) + len(_W_MATH.findall(body)) + len(_W_RAW.findall(body))
    pres = _count(r"<pre\b", body, re.I)
    body = _W_RAW.sub(" ", _W_MATH.sub(" ", _W_CODE.sub("\n", body)))
    comments = len(_COMMENT.findall(body))
    body = _UNSEEN.sub(" ", _COMMENT.sub("", body)) if not codes else body
    dollars = len(_DOLLAR.findall(body)) + _count(r"\$\$.+?\$\$", body, re.S)
    display = _count(_DISPLAY, body)
    environments = _count(r"\\begin\{(?:equation|align|gather|multline|eqnarray|displaymath)\*?\}", body)
    body = _DOLLAR.sub(" ", _TEX_MATH.sub(" ", body))
    tags = _tags(body)
    return {
        "latex": codes + environments + _count(_T_HEAD, body) + _count(r"^[ \t]*\\item\b", body) + _count(_T_INLINE, body),
        "wiki": w_code + _count(_W_INLINE, body) + _count(_W_HEAD.pattern, body) + _count(r"^\{\||^\|\}|^\{\{", body) + _count(r"^(?:\*+|#+)(?!\s|#|\*|include|define|if|end|pragma|else|undef|!)(?![^*\n]*\*)\S|^#{1,6} ?[^\s#][^\n]*\n#{1,6} ?[^\s#]", body) + _count(r"<ref\b", body),
        "markdown": fences + _count(_MD_INLINE, body) + _count(_LINK_LINE.pattern, body) + _count(r"^\|?[ \t]*:?-+:?[ \t]*\|[ \t:|-]*$", body),
        "html": len(tags),
        "pre": pres,
        "dollars": dollars,
        "display": display,
        "comments": comments,
        "entities": len(_ENTITY.findall(body)),
        "blocks": _count(r"^ {0,3}#{1,6} +\S|^[ \t]*(?:[-*+]|\d{1,9}[.)]) +\S|^ {0,3}> ?\S", body) + _underlined(body),
        "document": _count(r"<!DOCTYPE\s+html|<html\b|<body\b", plain, re.I) if not fences else 0,
        "block_tags": sum(t in BREAKS for t in tags),
    }


def language_of(text: str, hint: str = "") -> str | None:
    """The main language of a text, or None for plain text. `hint` ('html', ...) decides only where the marks do not."""
    n = marks(text)
    if n["latex"]:
        return "latex"
    if n["wiki"]:
        return "wiki"
    if n["markdown"] or n["blocks"]:
        if n["document"] or n["html"] > 10 * (n["markdown"] + n["blocks"]) and n["block_tags"] > 2:
            return "html"
        if not n["markdown"] and not n["html"] and hint == "wiki":
            return "wiki"
        return "markdown"
    if n["html"] or n["pre"] or n["comments"] or n["entities"]:
        return "html" if n["html"] or not n["pre"] or hint != "wiki" else "wiki"
    if n["display"]:
        return "latex"
    if n["dollars"]:
        return hint if hint in ("latex", "markdown") else "markdown"
    return None


def hint_of(mime: str | None, path: str | None) -> str:
    """The language that a type or else a path's extension states."""
    for text, by in ((mime or "", {"html": "html", "x-tex": "latex", "latex": "latex", "wiki": "wiki", "markdown": "markdown"}), (path or "", {".html": "html", ".htm": "html", ".tex": "latex", ".wiki": "wiki", ".md": "markdown"})):
        for part, language in by.items():
            if part in text.lower():
                return language
    return ""


def streams(text: str | None, hint: str = "") -> list[Stream]:
    """The token streams of a text, one per language of which it holds markup; none for plain, null and empty texts."""
    main = language_of(text, hint) if text else None
    if main is None:
        return []
    found = [_READERS[main](text)]
    if main in ("markdown", "wiki") and found[0].html:
        inner = hypertext("\n".join(found[0].html))
        found.append(Stream("html", [t for t in inner.tokens if t[0] in (HEADING, ITEM, CODE)]))
    return found


def counts(stream: Stream) -> list[int]:
    """How many headings, list items, code blocks and formulas a stream has."""
    return [sum(k == kind for k, _, _ in stream.tokens) for kind in COUNTED]


def clean_text(text: str | None, hint: str = "") -> str | None:
    """The text without its markup; a text without markup as it is."""
    found = streams(text, hint)
    return render(found[0]) if found else text


def render(stream: Stream) -> str:
    """Clean text: headings as '# ', items as '- ', code between fences, formulas between '$$' or within their line."""
    clean, out = _CLEAN[stream.language], []
    for kind, text, depth in stream.tokens:
        if kind == CODE:
            out.append("```\n" + (text).strip("\n") + "\n```")
        elif kind == FORMULA:
            if depth >= 0:
                out.append("$$ " + re.sub(r"^(?:\$\$|\\[\[(])\s*|\s*(?:\$\$|\\[\])])$", "", text) + " $$")
        elif kind == HEADING:
            out.append("#" * max(depth, 1) + " " + clean(text).strip())
        elif kind == ITEM:
            out.append("  " * depth + "- " + clean(text).strip())
        elif stream.language in ("markdown", "wiki") and any(t in BREAKS and t != "br" for t in _tags(text)):
            out.append(render(hypertext(text)))
        else:
            out.append(clean(text).strip())
    return "\n".join(x for x in out if x)


def _latest(files: DataFrame, read, result: str) -> DataFrame:
    """(file_id, got): `read` of the content of every file; of repeated rows of a file the latest scanned_at counts.

    Contents are read before the shuffle, and only what was read off them travels.
    """
    narrow = files.select(F.col("file_id").cast("long").alias("file_id"), F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("at"), F.col("mime_type"), F.col("path"), F.col("content")).filter("file_id IS NOT NULL")

    def run(batches):
        for b in batches:
            got = [read(t, hint_of(m, p)) for m, p, t in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, result_type)], ["file_id", "at", "got"])

    result_type = pa.list_(pa.list_(pa.int64())) if result.startswith("array") else pa.string()
    rows = narrow.mapInArrow(run, f"file_id long, at long, got {result}")
    return rows.groupBy("file_id").agg(F.max_by("got", F.struct("at", F.xxhash64("got"))).alias("got"))


def markup_counts(files: DataFrame) -> DataFrame:
    """(file_id, markup, headings, list_items, code_blocks, formulas): one row per file and language of which it holds markup.

    Null and empty contents and plain text give no row, nor do rows without file_id. Other columns are ignored.
    """

    def read(text, hint):
        return [[LANGUAGES.index(s.language), *counts(s)] for s in streams(text, hint)]

    each = _latest(files, read, "array<array<long>>").select("file_id", F.explode("got").alias("g"))
    names = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.col("g")[0].cast("int") + 1)
    return each.select("file_id", names.alias("markup"), *[F.col("g")[i + 1].alias(n) for i, n in enumerate(("headings", "list_items", "code_blocks", "formulas"))])


def clean_texts(files: DataFrame) -> DataFrame:
    """(file_id, text): every file's clean text, null where the content is null; plain text unchanged."""
    return _latest(files, clean_text, "string").withColumnRenamed("got", "text")
