"""Template residue and error-page text: documents to keep out of an index.

Two kinds of evidence are looked for. A placeholder that stands unfilled in running text condemns a document wherever it
stands outside code and quotation. Filler, error messages and scripts-required notices condemn it only if nothing else is
left: normalised lines are counted by host, lines that recur in many documents of a host are subtracted as boilerplate, and
the residual of a document (its lines that are neither evidence nor a title, navigation or reference line) must be empty.

Plan: one Arrow pass over the texts (most leave it after a search for word stems) returns the residual lines of the few
documents with evidence; these are joined with the line counts of all documents, which are aggregated map-side by (host, line hash). No host is
ever gathered in a task, and a host with a third of all rows spreads by the line hash.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is boilerplate of its host if it occurs in so many of the host's documents, and in such a share of them.
RECUR_DOCS, RECUR_SHARE = 3, 0.0005

# fixed values: the ways templates mark a slot to be filled
_NAME = r"[A-Za-z_][\w.\-]*"
_UPPER = r"[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*"
PLACEHOLDERS = [
    r"\{\{\{?\s*[#/>&^]?\s*" + _NAME + r"(?:\s+" + _NAME + r")*\s*(?:\|\s*" + _NAME + r"[^{}\n]{0,40})?\}?\}\}",
    r"\{%-?\s*" + _NAME + r"[^%{}\n]{0,60}-?%\}",
    r"<%[=-]?\s*" + _NAME + r"[^%<>\n]{0,40}%>",
    r"[$#]\{\s*" + _NAME + r"\s*\}",
    r"(?<![\w$])\$" + _UPPER + r"\$(?![\w$])",
    r"(?<![\w%])%" + _UPPER + r"%(?![\w%])",
    r"%\(" + _NAME + r"\)[sd]",
    r"\[(?i:your|insert|enter|add|fill in|ins[ée]rer|insertar|inserte|einf[üu]gen|ihr|votre|su)\s[^\[\]\n]{1,40}\](?!\()",
    r"\[[^\[\]\n]{1,40}\s(?i:here|buraya|ici|aqu[íi]|hier|einf[üu]gen|eintragen|ekleyin|girin|goes here)\](?!\()",
    r"(?<![\w\[\]!])\[(?!(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|OK|NOTE|TOC|REDACTED)\])[A-Z][A-Z0-9]{2,}(?:[_ ][A-Z0-9]+)*\](?![(\[:])",
    r"\[\[" + _UPPER + r"\]\]",
    r"<<\s*" + _NAME + r"\s*>>",
    r"<(?i:your|insert|enter)[-_ ][\w\- ]{1,40}>",
    r"(?<![\w{$#%\\)])\{[A-Za-z]+(?:_[A-Za-z]+)*\}(?![\w}(\[])",
    r"(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)",
    r"(?<![\w@])@@" + _NAME + r"@@(?![\w@])",
    r"\*\|[A-Z][A-Z0-9_:]*\|\*",
]
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
#: Cheap sign of a possible placeholder.
_MAYBE_SLOT = r"\{\{|\{%|<%|[$#]\{|\$[A-Z]|%[A-Z(]|\[(?:[A-Z\[]|[^\]\n]*[ ]\w*(?i:here|buraya|ici|aqu[íi]|hier|f[üu]gen|tragen|ekleyin|girin)\]|(?i:your|insert|enter|add |fill |ins[ée]r|einf|ihr |votre |su ))|<<|<[YyIiEe][A-Za-z]+[-_ ]|\{[A-Za-z]|__[A-Z]|@@|\*\|"
_SLOT = re.compile(_MAYBE_SLOT)

# fixed values: vocabulary of evidence in the five languages of the corpus
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split())
_SCRIPT_NOUN = r"java\s?script\w*|\bjs\b|\bscripts?\b|\bscripting\b|\bskript\w*|\bbetik\w*"
_SCRIPT_NEED = (
    r"enabl|activ|turn(?:ed)? (?:it )?on|switch(?:ed)? (?:it )?on|allow|need|requir|depend|only with|disabled|blocked|(?:seems to be|is|are|turned|switched) off\b|without|unless|must"
    r"|aktiv|schalten|benötig|erforder|nur mit|ohne|habilit|necesi|requier|funciona|besoin|nécess|fonctionne|autoris|etkin|açın|aktif|gerek|olmadan|çalışma"
)
_ERROR = (
    r"\b(?:http|error|status|code|fehler|erreur|hata)[ :/]*(?:status )?[1-5]\d\d\b|^\W*[45]\d\d\W*$|\b[45]\d\d\b\W{0,3}(?:not found|forbidden|unauthori[sz]ed|gone|bad|gateway|service|internal|too many|request|conflict|not allowed|access)"
    r"|^\W*(?:[45]\d\d\W+)?(?:not found|forbidden|unauthori[sz]ed|gone|bad gateway|bad request|gateway time-?out|service unavailable|internal server error|too many requests|request time-?out|method not allowed|payment required)\W*(?:[45]\d\d)?\W*$"
    r"|^fatal error\b|^(?:parse|syntax|runtime) error\b|^warning: .*\b(?:line \d+|expects|given)|^traceback \(most recent|^file \".*\", line \d+|^\w*(?:error|exception): |^panic: |^goroutine \d+|^exception in thread|^at [\w.$]+\([\w.]+:\d+\)|segmentation fault|\{\s*\"(?:error|errors|fault|exception)\"\s*:"
    r"|\(reason: [\w -]+\)\W*$|(?:could not|cannot|can't|couldn't|can not|failed to|unable to) (?:be )?(?:load|found|find|open|display|reach|connect|process|render|retriev|shown?)\w*|(?:no longer|not|doesn't|does not) (?:exist|available|valid|reachable|found|allowed|accessible)\w*"
    r"|(?:has|have|was|were) (?:been )?(?:moved|expired|removed|deleted|timed out)|access (?:is )?denied|(?:not have|no|lacks?|need|insufficient|without) (?:the |more |sufficient )?(?:permission|rights|access|authori)\w*|not meant for you|(?:something|problem|fault|error)\w* (?:\w+ )?(?:went wrong|got in the way|occurred|happened)|(?:temporary|unknown|unexpected) (?:fault|problem|error)"
    r"|(?:down|updated|closed|offline|available) for (?:\w+ )?maintenance|under maintenance|not available (?:right now|at the moment)|temporarily unavailable|too many requests|rate limit|unusual traffic|quota exceeded|back end before the first byte|session (?:has )?(?:expired|timed out)"
    r"|nicht gefunden|existiert nicht|nicht geladen|keine berechtigung|zugriff (?:wurde )?verweigert|abgelaufen|nicht (?:mehr )?(?:verfügbar|gültig|erreichbar)|ist ein fehler|schiefgelaufen|zu viele anfragen|wartungsarbeiten|gesperrt"
    r"|introuvable|n'existe (?:plus|pas)|n'a pas (?:pu|été)|accès (?:refusé|interdit)|expirée?\b|indisponible|une erreur|trop de requêtes|en maintenance|n'est (?:plus|pas) (?:disponible|valide|accessible)"
    r"|no existe|no se (?:encontró|encuentra|pudo|ha podido)|no encontrad[oa]|acceso denegado|caducado|expirado|no está disponible|ha ocurrido un|demasiadas (?:peticiones|solicitudes)|en mantenimiento|no tiene permiso|algo salió mal"
    r"|bulunamadı|yüklenemedi|artık yok|artık mevcut değil|engellendi|sona erdi|reddedildi|bir hata|süresi doldu|izniniz yok|yetkiniz yok|kullanılamıyor|bakımda|çok fazla istek"
)
_FOLLOW = (
    r"\b(?:try|once more|again later|again|reload|refresh|sign in|log in|login|contact (?:the|your|us)|check back|check your|request a new|switch it on|enable it|turn it on|stays? hidden|nothing can be|slow down|wait a|solve the|checking your browser|loading|redirecting|please wait|go back|back to|return to|home ?page)\b"
    r"|bitte|melden sie|wenden sie|zurück|erneut|veuillez|reconnect|retour|réessay|inicie|inténte|vuelva|volver|contacte|póngase|lütfen|başvurun|\bdön|tekrar|giriş yap|cookies"
)
_STUB = (
    r"^\W*(?:your (?:text|title|content|name)(?: goes)? here|click (?:here )?to (?:edit|add)\b.*|add (?:content|text|title)\b.*|sample (?:paragraph )?text|placeholder(?: text)?|todo\b.*|fixme\b.*|tbd|tba|xxx+|n/?a|(?:text|content|body|description|title|copy) (?:goes here|to follow|to come|to be (?:added|done|defined)|will (?:be added|follow)\b.*|coming soon)|coming soon|insert (?:text|content)(?: here)?|(?:under|en) (?:construction|construcción)|replace this \w+ with your own(?: \w+)?|write (?:this|something)(?: here)?"
    r"|(?:texte?|contenu|description) à (?:venir|compléter|ajouter|rédiger)|(?:texto|contenido|descripción) (?:próximamente|por (?:añadir|completar|definir)|pendiente)|próximamente|(?:text|inhalt|beschreibung) (?:folgt|hier)\b.*|hier (?:steht|kommt|folgt) .{0,40}|(?:inhalt|text) wird .{0,30}(?:ergänzt|nachgereicht)|buraya .{1,30} (?:eklenecek|gelecek|yazın|ekleyin)|(?:metin|içerik|açıklama) (?:yakında|eklenecek|gelecek|buraya).{0,20}|\.\.\.|…)\W*$|^\W*(?:\.\.\.|…)\W*$"
)
_RX = {k: re.compile(v, re.I) for k, v in {"noun": _SCRIPT_NOUN, "need": _SCRIPT_NEED, "error": _ERROR, "follow": _FOLLOW, "stub": _STUB}.items()}
# fixed values: a text in lower case without any of these stems has nothing that the patterns above match, random keys and repetitions aside
_STEMS = (
    "javascript betik skript js http error fault fehler erreur hata code status reason: could cannot can't fail unable denied permission rights problem maintenance requests quota nicht keine verweig abgelaufen schiefgel"
    " anfragen wartung gesperrt introuvable n'ex n'est accès expir indispon encontr acceso caducad solicitud permiso salió bulunam yüklenem artık engellendi redded süresi iznin yetkin kullanıl bakım istek forbidden unauthori"
    " gone gateway unavailable time-out timeout payment warning traceback exception panic goroutine segmentation click sample placeholder fixme tbd tba xxx n/a construc replace próximamente pendiente folgt hier buraya"
    " yakında eklenecek gelecek ... … lorem ipsum dolor amet aliqua magna"
).split() + [before + "script" for before in " \n\"'(-"] + ["can not", "not ", "n't ", "no longer", "have ", "has ", "was ", "were ", "something", "rate limit", "unusual", "back end", "session has", "session timed", "no existe", "no se", "no está", "no tiene", "ha ocurrido", "sona erdi", "bad request", "n'a pas", "file \"", "your ", "add ", "goes here", "to follow", "to come", "to be", "will ", "coming soon", "insert", "write ", "à venir", "à compl", "à ajout", "à rédig", "por añadir", "por completar", "por definir", "wird "]


def _finder(stems: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in stems:
        found.add_word(x, x)
    found.make_automaton()
    return found


_FINDER = _finder(_STEMS)
_ODD = re.compile(r"\n[^\w\n]*(?:[45]\d\d|todo)\b")
_ODD_KEYS = re.compile(r"[jqkwxz]{2}")
_MASHED = re.compile(r"\b(?=[a-z]{3,}\b)(?:[^aeiouy\W]+|\w*[^aeiouy\W]{4}\w*|\w*[jqkwxz]{2}\w*|\w*q[^u\W]\w*)\b")
_CODE_LINE = re.compile(
    r"^\s*(?:def |class |return\b|import |from \w+ import|if .*[:{]$|for .*[:{]$|while .*[:{]$|func |fmt\.|log\.|console\.|const |let |var |export |public |private |package |#include|SELECT\b|WHERE\b|AND\b|OR\b|FROM\b|JOIN\b|GROUP BY\b|ORDER BY\b|INSERT\b|UPDATE\b|[\w.\[\]]+ (?::?=|\+=) |[})\];]+\s*$|//|/\*|\*/|@\w+|# \w+_\w+|<\?php|\}? ?else)"
)
_SPEECH = re.compile(r"`[^`\n]*`|\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|(?<!\w)'[^'\n]{1,200}'(?!\w)|‘[^’\n]{1,200}’(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")


def outside_code(text: str) -> list[str]:
    """The lines of a text outside fenced and indented code; none if the text as a whole is source code."""
    lines, fence = [], ""
    for line in re.split(r"\r\n|\r|\n", text):
        mark = re.match(r"^\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1].startswith(fence):
                fence = ""
            continue
        if mark:
            fence = mark[1]
        elif not re.match(r"^(?: {4,}|\t)\S", line) or not _CODE_LINE.match(line):
            lines.append(line)
    return lines


def is_source(lines: list[str]) -> bool:
    """Whether most lines that are not blank are program text."""
    filled = [x for x in lines if x.strip()]
    return bool(filled) and sum(bool(_CODE_LINE.match(x)) for x in filled) * 2 > len(filled)


def has_slot(lines: list[str]) -> bool:
    """Whether an unfilled placeholder stands in these lines outside quotation."""
    return any(not x.lstrip().startswith(">") and _PLACEHOLDER.search(_SPEECH.sub(" ", x)) for x in lines if _SLOT.search(x) and _PLACEHOLDER.search(x))


def _is_filler(words: list[str], text: str) -> bool:
    if len(words) >= 3 and sum(w in LOREM for w in words) * 10 >= 8 * len(words):
        return True
    if len(words) >= 6 and len(set(words)) * 4 <= len(words):  # one or two words over and over
        return True
    if len(words) >= 5 and all(w.isascii() for w in words):
        # keys hit at random: most words have no vowel where one belongs
        return len(_MASHED.findall(" ".join(words))) * 2 > len(words)
    return bool(re.fullmatch(r"\W*(\w{1,4}?)\1{15,}\w{0,3}\W*", text))


def kind_of(sentence: str) -> str:
    """'script', 'error' or 'filler' for evidence, 'follow' for what goes with it, 'label' for a title or navigation, else 'content'."""
    bare = sentence.strip().lstrip("#>*-+•|=_ \t").strip()
    words = re.findall(r"[^\W\d_]+", bare.lower())
    if not words:
        return "filler" if _RX["stub"].match(bare) else "error" if _RX["error"].search(bare) else "label"
    if len(words) > 6 and not may_hold_evidence(bare):
        return "follow" if len(words) <= 14 and _RX["follow"].search(bare) else "content"
    quoted = _SPEECH.sub(" ", bare) if not _RX["error"].match(bare) else bare
    if _RX["stub"].match(bare) or _is_filler(words, bare):
        return "filler"
    if len(words) <= 24:
        if _RX["noun"].search(quoted) and _RX["need"].search(quoted):
            return "script"
        if _RX["error"].search(quoted) and (len(quoted) * 10 > len(bare) * 7):
            return "error"
    if len(words) <= 14 and _RX["follow"].search(bare):
        return "follow"
    if len(words) <= 2 and bare[-1] == "!" or re.fullmatch(r"\S{60,}", bare):  # an interjection; a run of signs that no one reads
        return "follow"
    ends = bare[-1] in ".!?" and not bare.endswith("..")
    return "content" if (ends or len(words) > 6) else "label"


def _after_title(line: str) -> str:
    """What follows a short title on its line, set off by a dash or colon; the line itself if nothing does."""
    m = re.match(r"^[^.!?:|{}\"]{2,60}?(?:\s+[-–—]\s+|:\s+)(?=\S)", line)
    return line[m.end() :] if m and len(m[0].split()) <= 6 else line


def may_hold_evidence(text: str) -> bool:
    """False only for texts in which no sentence can be evidence."""
    low = "\n" + text.lower()
    if next(_FINDER.iter(low), None) or _ODD.search(low):
        return True
    words = low.split()
    if any(a == b == c for a, b, c in zip(words, words[2:], words[4:])) or max(map(len, words), default=0) >= 60:
        return True
    return bool(_ODD_KEYS.search(low)) and len(_MASHED.findall(low)) * 3 > len(words)


def judge(text: str) -> tuple[bool, list[str]]:
    """(evidence, residual lines). A case: evidence and no residual line that is not boilerplate of its host.

    Null, empty and blank texts and source code have no evidence. A placeholder gives evidence and no residual.
    """
    if not text or not text.strip():
        return False, []
    slot, sign = _SLOT.search(text), may_hold_evidence(text)
    if not slot and not sign:
        return False, []
    every = re.split(r"\r\n|\r|\n", text)
    if is_source(every):
        if not any(_RX["error"].match(x.strip()) for x in every):
            return False, []
        lines = outside_code(text)
    else:
        lines = outside_code(text)
        if slot and has_slot(lines):
            return True, []
        if not sign:
            return False, []
    found, residual = False, []
    for line in lines:
        if not line.strip():
            continue
        kinds = [kind_of(s) for s in _SENTENCE.split(line)]
        if "content" in kinds or "label" in kinds:
            rest = _after_title(line)
            if rest is not line:
                other = [kind_of(s) for s in _SENTENCE.split(rest)]
                if any(k in ("script", "error", "filler") for k in other):
                    kinds = other
        found |= any(k in ("script", "error", "filler") for k in kinds)
        if "content" in kinds:
            residual.append(line)
    return found and len(lines) == len(every), residual  # a code block is content


def line_hash(line: Column) -> Column:
    """A line in lower case, without digits and repeated blanks, as 64 bits."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\d+", "0"), r"\s+", " "))


def recurrent_lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """(host, line): hashes of normalised lines that recur in RECUR_DOCS documents and RECUR_SHARE of the documents of a host.

    A line counts once a document. Documents without a host form one host.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), line_hash))
    by_host = docs.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed(host, "h")
    counted = docs.select(host, F.explode(lines).alias("line")).groupBy(host, "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECUR_DOCS)
    return counted.join(by_host, F.col(host).eqNullSafe(F.col("h"))).filter(F.col("n") >= F.col("n_docs") * RECUR_SHARE).select(host, "line")


def condemned(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(key): documents with an unfilled placeholder, or of which nothing but filler, error text or a scripts notice is left.

    A repeated key comes out once. Null, empty and blank texts, and a null key, give no rows; columns besides the three are ignored.
    """
    narrow = docs.select(F.col(key).cast("long").alias("_k"), F.col(host).alias("_h"), F.col(text).alias("_t")).filter("_k IS NOT NULL")

    def run(batches):
        for b in batches:
            keys, hosts, texts = (b.column(i) for i in range(3))
            rows = [(k, h, r) for k, h, t in zip(keys.to_pylist(), hosts.to_pylist(), texts.to_pylist(), strict=True) for e, r in [judge(t)] if e]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["_k", "_h", "residual"]
            )

    filled = narrow.filter(F.trim("_t") != "")
    judged = filled.mapInArrow(run, "_k long, _h string, residual array<string>")
    lines = judged.select("_k", "_h", F.explode_outer("residual").alias("raw")).select("_k", "_h", F.when(F.col("raw").isNotNull(), line_hash(F.col("raw"))).alias("line"))
    known = recurrent_lines(filled, "_h", "_t").select(F.col("_h").alias("_h2"), F.col("line").alias("line2"), F.lit(1).alias("known"))
    left = lines.join(known, F.col("_h").eqNullSafe(F.col("_h2")) & (F.col("line") == F.col("line2")), "left")
    kept = left.groupBy("_k").agg(F.max((F.col("line").isNotNull() & F.col("known").isNull()).cast("int")).alias("content"))
    return kept.filter("content = 0").select(F.col("_k").alias(key))
