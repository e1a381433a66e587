"""Broken question-answer pairs (problem 5).

Method: a pushdown parser over fences, brackets, quotations, lists and markup decides whether an
answer was cut off; greedy string tiling finds copies of the question; scripts, function words and
trained trigram profiles tell languages apart (profiles.py); refusals are parsed by a grammar whose
symbols are classes of sentences and clauses.

Answers are judged where they are read: nothing is shuffled.

Defined results: a null answer is `empty`; a null or blank question is never copied and has no
language; an empty or copied answer has no other defect; repeated rows are judged alike; an empty
table gives an empty table; further columns pass through, and the added column is named `defects`, replacing any so named.
Texts are judged whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.profiles import Profile, foreign, lead, trigrams
from valora.runtime import spread

DEFECTS = ("empty", "copies_question", "truncated", "refusal", "other_language")

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


# What stands for an answer without being one (in plain form), and labels.
PLACEHOLDERS = {
    "n a", "na", "n d", "nd", "s a", "s d", "s n", "null", "none", "nan", "nil", "nulo", "vacio", "ninguno", "ninguna", "undefined", "tbd", "todo", "xxx",
    "pendiente", "por completar", "por definir", "completar", "sin respuesta", "sin justificacion", "sin texto", "sin contenido", "no answer", "empty",
    "lorem ipsum", "texto", "texto aqui", "justificacion aqui", "tu respuesta", "your answer", "your answer here",
}
LABELS = "justificacion|justification|respuesta|answer|response|puntaje|score|comentario|comentarios|sustento|observacion|observaciones|analisis|evaluacion|texto relevante|relevant text|nivel|explicacion|fundamento|conclusion|resultado"
_LABEL_ONLY = re.compile(rf"(?:{LABELS}|relevant_text)(?: (?:{LABELS}))*")
# a mark in angle brackets: short text, or a tag of any length whose attributes have values
_TAG = re.compile(r"""<(?:[^<>]{0,80}|/?[A-Za-z][\w-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'))+\s*/?)>""")
_FENCE = re.compile(r"```\w*")


def visible(text: str | None) -> str:
    """The answer without invisible marks and outer white space."""
    return "" if text is None else _INVISIBLE.sub("", text).strip()


def unwrapped(text: str) -> str:
    """The answer's own text where it stands in a JSON object, a fence or markup."""
    t = _FENCE.sub(" ", text).strip() if text.count("```") >= 2 else text
    if t[:1] in "{[\"":
        try:
            o = json.loads(t)
        except ValueError:
            return t
        if isinstance(o, dict):
            o = next((o[k] for k in ("justification", "justificacion", "justificación", "answer", "respuesta", "text") if isinstance(o.get(k), str)), "" if not any(isinstance(v, str) and v.strip() for v in o.values()) else t)
        return o.strip() if isinstance(o, str) else ("" if not o else t)
    return t


def is_empty(text: str) -> bool:
    """No answer at all: nothing visible, marks only, a placeholder or a bare label."""
    t = plain(_TAG.sub(" ", unwrapped(text)))
    words = _WORD.findall(t)
    if not words:
        return True
    joined = " ".join(words)
    if joined in PLACEHOLDERS:
        return True
    return bool(_LABEL_ONLY.fullmatch(joined)) and not any(c.isdigit() for c in joined)


# ---- truncation -------------------------------------------------------------------------------

_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "‹": "›"}
_CLOSERS = {v: k for k, v in _PAIRS.items()}
_TAG_PARTS = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_MARK = re.compile(rf'```|{_TAG_PARTS.pattern}|[{re.escape("".join(_PAIRS) + "".join(_CLOSERS))}"]')
_ENUM = re.compile(r"(?:^|\n|\s)(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})$")


def open_at_end(text: str) -> list[str]:
    """What a pushdown parser still holds open at the end: fences, markup, quotations, brackets.

    A closing mark pops down to its opener; one without an opener, as after a list's number, is
    text. A straight quote opens before a word and closes after one.
    """
    stack: list[str] = []
    for m in _MARK.finditer(text):
        c, i = m.group(), m.start()
        if c == "```":
            if c in stack:
                del stack[stack.index(c) :]
            else:
                stack.append(c)
        elif c[0] == "<":
            t = _TAG_PARTS.match(c)
            tag = "<" + t.group(2).lower()
            if t.group(1):
                if tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            elif not t.group(3) and tag not in ("<br", "<hr", "<img", "<li", "<p"):
                stack.append(tag)
        elif c in _PAIRS:
            stack.append(c)
        elif c in _CLOSERS:
            want = _CLOSERS[c]
            if want in stack and not (c == ")" and stack[-1] != "(" and _ENUM.search(text[max(0, i - 6) : i])):
                del stack[len(stack) - 1 - stack[::-1].index(want) :]
        elif c == '"':
            if c in stack:
                del stack[stack.index(c) :]
            else:
                stack.append(c)
    return stack


_OMISSION = re.compile(
    r"(?:\s*(?:…|\.{3,}|[\[(]\s*(?:…|\.{2,})\s*[\])]|[\[(]?\s*(?:contin[uú]a(?:r[aá])?|contin[uú]ed|continues|sigue|cont|to be continued|suite)\b\.{0,3}…?\s*[\])]?))+$",
    re.I,
)
_SCORE = re.compile(r"\s*[(\[]?\s*(?:puntaje|nivel|score|level|calificaci[oó]n|nota|puntuaci[oó]n|valor)(?:\s+(?:asignad[oa]|final|assigned))?\s*[:=]?\s*-?\d+(?:[.,]\d+)?(?:\s*(?:/|de|of)\s*\d+)?\s*[)\]]?\.?$", re.I)
_DONE = re.compile(r"[.!?](?:[\"'»”’)\]*_`]|</\w+>)*$|[\"»”]$|:\)$")
# Abbreviations after which a sentence goes on.
_ABBREVIATION = re.compile(r"(?:^|[\s(«\"])(?:art|arts|inc|incs|cap|pág|págs|pag|núm|num|nro|lit|fig|ej|sr|sra|dr|dra|ing|lic|vs|p|pp|S/|N|n|U|EE|aprox)\.$")
_VALUE = re.compile(r"(?:s[ií]|no|parcial(?:mente)?|total(?:mente)?|alt[oa]|medi[oa]|baj[oa]|n/?a|yes|partial(?:ly)?|[A-Z]{0,3}/?\s*-?\d[\d\s.,]*(?:%|m²|m2|km²?|ha|hogares|registros|personas|soles|días|meses|años|puntos|households|records|per cent)?)$", re.I)
# Words with which a verdict without a full stop begins.
_VERDICT = re.compile(
    r"(?:(?:s[ií]|no|parcial\w*|total\w*|plen\w*|cumple|cumplid[oa]|incumple|no (?:cumple|aplica|corresponde|procede)|avance|nivel|puntaje|logro|grado|alt[oa]|medi[oa]|baj[oa]"
    r"|suficiente|insuficiente|adecuad[oa]|inadecuad[oa]|aceptable|deficiente|buen[oa]?|regular|excelente|satisfactori[oa]|yes|partially|fully|met|not met|level|high|medium|low|complies)\b)",
    re.I,
)
_DANGLING = {"el", "la", "los", "las", "de", "del", "y", "o", "en", "a", "con", "por", "para", "que", "un", "una", "se", "al", "su", "no", "the", "of", "and", "in", "to", "with"}


def is_truncated(text: str) -> bool:
    """Whether the answer stops before its last sentence or quotation is finished."""
    t = unwrapped(text)
    m = _OMISSION.search(t)
    if m and m.start() > 0:
        head = t[: m.start()].rstrip()
        if not _DONE.search(head) or _ABBREVIATION.search(head):
            return True
        t = head
    if open_at_end(t):
        return True
    s = _SCORE.search(t)
    if s:
        t = t[: s.start()].rstrip()
        if not t:
            return False
    if _DONE.search(t):
        return bool(_ABBREVIATION.search(t))
    line = t.rsplit("\n", 1)[-1].strip()
    item = re.match(r"(?:[-•*·–]|\d+[.)]|[a-z][.)])\s+(.*)$", line)
    words = _WORD.findall(t)
    if item or re.match(r"[^:]{1,80}:\s*\S", line):
        value = (item.group(1) if item else line).rpartition(":")[2].strip()
        if ":" in line and _VALUE.match(value):
            return False
        return not (item and len(words) <= 6 and _VERDICT.match(item.group(1)))
    if len(words) <= 6 and _VERDICT.match(t) and words[-1].lower() not in _DANGLING:
        return False
    if _VALUE.match(t):
        return False
    return True


# ---- refusals ---------------------------------------------------------------------------------

# The grammar's terminals, over plain text. A declining clause joins "I can't" to "judge or answer".
_UNABLE = (
    r"(?:no (?:me )?(?:puedo|podre|podria|es posible|sera posible|resulta posible|estoy en condiciones|estoy en capacidad|estoy autorizad\w|tengo permitido|tengo autorizacion|tengo permiso|me esta permitido|me corresponde|soy capaz|corresponde|compete|hallo en condiciones|encuentro en condiciones|siento en condiciones|quisiera|deseo|voy a|debo|logro)"
    r"|me (?:es|resulta) imposible|me abstengo|me abstendre|debo abstener\w*|prefiero (?:no|abstener\w*)|preferiria no|opto por no|declino|rehuso|rechazo|me niego|me excuso|me veo impedid\w|me veo obligad\w a declinar|evitare|"
    r"no esta (?:en|dentro de) mis (?:funciones|capacidades)|imposible para mi|"
    r"i (?:can ?not|can ?t|am (?:not able|unable)|m (?:not able|unable)|won ?t|will not|must decline|decline|refuse|prefer not|would rather not|am sorry but|do not feel able)|"
    r"je (?:ne (?:peux|puis|suis|souhaite)|refuse|prefere|dois m abstenir|regrette)|"
    r"(?:eu )?nao (?:posso|consigo|estou|me e possivel|sou capaz)|prefiro nao|recuso)"
)
_JUDGE = (
    r"(?:valora\w*|evalua\w*|avalia\w*|evalue\w*|califi\w*|juzg\w*|julga\w*|juger|respond\w*|contest\w*|emit\w*|asign\w*|opina\w*|opine\w*|atend\w*|ayud\w*|ajuda\w*|puntua\w*|pronunci\w*|analiz\w*|asist\w*|proporcion\w*|ofrec\w*|dictamin\w*|revis\w*|proces\w*|continu\w*|complet\w*|cumplir con|realiz\w*|brind\w*|"
    r"judge|assess|evaluate|rate|score|grade|provide|answer|respond|help|assist|give|offer|comment|fulfil\w*|comply|complete|"
    r"repondre|noter|donner|fournir|aider|attribuer|responder|fornecer|atribuir|solicitud|peticion|consulta|request|question)"
)
_CORE = re.compile(
    rf"\b{_UNABLE}\b.*?\b{_JUDGE}\b|\b(?:declino|rehuso|me niego|i must decline|i decline|i refuse)\b"
    r"|\bno (?:rating|score|assessment|evaluation|judge?ment|grade|answer)\b.*\b(?:can|will|could) be (?:given|provided|made|issued)\b"
    r"|\bning\w+ (?:puntaje|valoracion|calificacion|juicio)\b.*\b(?:puedo|puede|sera)\b"
)
_LEAD = re.compile(
    r"^(?:lo (?:siento|lamento)|lamento|le pido disculpas|pido disculpas|mil disculpas|disculp\w*|perdon\w*|lamentablemente|desafortunadamente|por desgracia|con (?:la debida cautela|todo respeto|el debido respeto)|"
    r"como (?:modelo|asistente|sistema|ia|inteligencia)\b.*|en (?:mi calidad|calidad|tanto) de (?:modelo|asistente)\b.*|soy (?:un|una) (?:modelo|asistente|ia|inteligencia)\b.*|as an? (?:ai|language|virtual|assistant)\b.*|"
    r"i ?m (?:sorry|afraid|just an?\b.*)|i am (?:sorry|afraid)|(?:i )?apolog\w*.*|sorry|unfortunately|regrettably|desole\w*|je suis desole\w*|malheureusement|en tant qu\w*\b.*|desculp\w*.*|sinto muito|lamento|infelizmente|como um modelo\b.*|pero|but|mais|mas|por ahora|en este caso|de momento)$"
)
_TAIL = re.compile(
    r"\b(?:gracias|por favor|favor de|disculp\w*|comprension|consult\w*|intent\w*|reformul\w*|sugier\w*|suger\w*|recomiend\w* (?:acudir|consultar|dirigirse)|acud\w*|puedo (?:ofrecer|ayudar|brindar|orientar)|informacion general|si lo desea|"
    r"mis (?:politicas|funciones|capacidades|lineamientos|limitaciones|directrices)|politicas de uso|excede|fuera de mi alcance|otra herramienta|un especialista|(?:requiere|requires|precisa|necesita)\b.*\b(?:persona|expert\w*|especialista|profesional|specialist|human)|corresponde a (?:una persona|un expert\w*|un especialista)|oficina encargada|quedo (?:a|atent)\w*|estoy a su disposicion|"
    r"thank\w*|please|my (?:guidelines|policies|capabilities|role)|consult|rephrase|try another|happy to help|let me know|merci|veuillez|obrigad\w*|por gentileza)\b"
)
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"")


_CLAUSE_ENDS = re.compile(r",|\bpero\b|\bbut\b|\bmais\b|\bmas\b|\bya que\b|\bporque\b|\bpues\b|\bpuesto que\b|\bdado que\b")

# The grammar's productions over sentences: D declines, F only fills, C says something. Clauses tell
# which: d declines, l leads in, t closes, s is short (two words), c says something, e is empty.
ANSWER = {
    "Refusal": [("Opening", "D", "Closing")],
    "Opening": [(), ("F", "Opening")],
    "Closing": [(), ("F", "Closing"), ("D", "Closing")],
}


def clause_symbols(sentence: str) -> list[str]:
    """The symbols of a sentence's clauses."""
    out = []
    for clause in _CLAUSE_ENDS.split(sentence):
        words = _WORD.findall(clause)
        flat = " ".join(words)
        out.append("e" if not words else "l" if _LEAD.match(flat) else "d" if _CORE.search(flat) else "t" if _TAIL.search(flat) else "s" if len(words) <= 2 else "c")
    return out


def sentence_symbol(sentence: str) -> str:
    """D, F or C: D if a clause, or the sentence over its clauses, declines; F if it closes as a whole
    or all its clauses fill."""
    if _CORE.search(sentence):
        return "D"
    clauses = clause_symbols(sentence)
    if "d" in clauses:
        return "D"
    if all(c in "elts" for c in clauses) or _TAIL.search(" ".join(_WORD.findall(sentence))):
        return "F"
    return "C"


def derives(symbol: str, word: tuple[str, ...], productions: dict[str, list[tuple[str, ...]]] | None = None) -> bool:
    """Whether a grammar's symbol yields a word, by recursive descent over all ways to go on."""
    rules = productions or ANSWER

    def ends(sym: str, at: int) -> set[int]:
        if sym not in rules:
            return {at + 1} if at < len(word) and word[at] == sym else set()
        out: set[int] = set()
        for body in rules[sym]:
            here = {at}
            for part in body:
                here = {e for h in here for e in ends(part, h)}
            out |= here
        return out

    return len(word) in ends(symbol, 0)


def is_refusal(text: str) -> bool:
    """Whether the answer declines to judge and says nothing on the fragment."""
    t = plain(_QUOTED.sub(" QUOTE ", unwrapped(text)).replace("’", "'"))
    t = t.replace("'", " ")
    symbols = []
    for sentence in re.split(r"[.!?;:\n]+", t):
        symbols.append(sentence_symbol(sentence))
        if symbols[-1] == "C":  # no production holds it
            return False
    return derives("Refusal", _squeezed(symbols))


def _squeezed(symbols: list[str]) -> tuple[str, ...]:
    """The word with runs of one symbol as one, which the grammar can't tell apart."""
    return tuple(s for s, before in zip(symbols, [None, *symbols], strict=False) if s != before)


# ---- copies -----------------------------------------------------------------------------------

# Words of lead-ins and scores that add nothing to a copied question.
_LEADIN = set(
    "pregunta preguntas respuesta responder se pide la el lo siguiente siguientes es a continuacion puntaje nivel asignado asignada score level question answer the following is please respond to"
    " enunciado consigna criterio evaluar analizar indica que consulta solicita sobre texto dice repito en cuanto de y como relacion con respecto nota calificacion final valor justificacion".split()
)


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of the longest common runs, none overlapping."""
    out: list[tuple[int, int, int]] = []
    used_a, used_b = [False] * len(a), [False] * len(b)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            if used_a[i]:
                continue
            for j in at.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j, k)]
                elif k == best and k >= least:
                    found.append((i, j, k))
        if not found:
            return out
        for i, j, k in found:
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                out.append((i, j, k))
                used_a[i : i + k] = [True] * k
                used_b[j : j + k] = [True] * k


def copies(question: str | None, text: str, cover: float = 0.8) -> bool:
    """Whether the answer repeats the question and adds nothing but a lead-in or a score."""
    q, a = _WORD.findall(plain(question or "")), _WORD.findall(plain(_TAG.sub(" ", unwrapped(text))))
    qs, have = set(q), set(a)
    # words that are neither the question's nor a lead-in's add something, however long the answer is
    if len(q) < 3 or any(w not in qs and w not in _LEADIN and not w.isdigit() for w in have):
        return False
    if sum(w in have for w in q) < cover * len(q):
        return False
    found = tiles(q, a)
    return sum(k for _, _, k in found) >= cover * len(q)


# ---- language ---------------------------------------------------------------------------------

# Function words that set the languages of the reports apart.
FUNCTION_WORDS = {
    "es": "el los las del y es con por una según entre para al lo su sus más como que se no la en de un fue pasó son está este esta sin hasta desde a o me mi mis pero ni si otro otra ya sobre".split(),
    "pt": "o os as do da dos das e é com uma um não em ao no na nos nas pelo pela durante mais são foi que se de sem seu sua conforme a este esta eu me meu minha mas ou ou por para sobre como está".split(),
    "en": "the of and in to with by most that report does is for is are not this it as during a an on from i my me can be or but".split(),
    "fr": "le les des et est avec par une un du au aux dans ne pas ce cette je sur pour que qui la de sans selon pendant plus il".split(),
    "it": "il lo gli della dello dei delle e è con per una un non che nel nella di la sono durante secondo più".split(),
}
_SETS = {k: set(v) for k, v in FUNCTION_WORDS.items()}
_COUNT = {w: sum(w in s for s in _SETS.values()) for s in _SETS.values() for w in s}
_HINTS = {"pt": re.compile(r"[ãõ]|ç(?:ão|ões)"), "es": re.compile(r"[ñ¿¡]|ción\b"), "fr": re.compile(r"[èêœùî]|\bl'|\bd'|\bqu'"), "it": re.compile(r"zione\b|\bdell'|\bl'")}
_SCRIPTS = {"cyrillic": re.compile("[Ѐ-ӿ]"), "greek": re.compile("[Ͱ-Ͽ]"), "arabic": re.compile("[\u0600-ۿ]"), "han": re.compile("[一-鿿぀-ヿ가-힯]")}

_ANY_SCRIPT = re.compile("|".join(rx.pattern for rx in _SCRIPTS.values()))


#: Nats by which a profile must lead to count as one function word, and the words it counts as at most.
LEAD_NATS = 10.0
LEAD_WORDS = 2.0


def evidence(text: str, profiles: dict[str, Profile], grams: list[str]) -> dict[str, float]:
    """What speaks for each language: function words and letters that set it apart, and its profile's lead."""
    low = text.lower().replace("’", "'")
    score = dict.fromkeys(_SETS, 0.0)
    for w in re.findall(r"[^\W\d_]+", low):
        c = _COUNT.get(w)
        if c:
            for k, s in _SETS.items():
                if w in s:
                    score[k] += 1.0 / c
    for k, rx in _HINTS.items():
        score[k] += min(2.0, 0.5 * len(rx.findall(low)))
    first = lead(grams, profiles)
    if first:
        score[first[0]] = score.get(first[0], 0.0) + min(LEAD_WORDS, first[1] / LEAD_NATS)
    return score


def language(text: str, least: float = 2.0, profiles: dict[str, Profile] | None = None) -> str | None:
    """The language of a text by script, function words and profiles; None without enough evidence."""
    if _ANY_SCRIPT.search(text):
        letters = sum(c.isalpha() for c in text)
        for name, rx in _SCRIPTS.items():
            if len(rx.findall(text)) > 0.5 * letters:
                return name
    score = evidence(text, {}, [])
    first, second = sorted(score, key=score.get, reverse=True)[:2]
    if profiles and (score[first] < 2 * least or score[first] < 2 * score[second]):  # words alone don't decide
        score = evidence(text, profiles, trigrams(text))
        first, second = sorted(score, key=score.get, reverse=True)[:2]
    return first if score[first] >= least and score[first] >= 1.25 * score[second] else None


_ASKED: dict[str, str | None] = {}


def other_language(question: str | None, text: str, profiles: dict[str, Profile] | None = None) -> bool:
    """Whether question and answer, quotations aside, are in two different languages.

    A text in no known language counts too if the profile of the question's language speaks against
    it and no function word for it. Questions recur, so their languages are remembered.
    """
    body = _SCORE.sub("", _QUOTED.sub(" ", unwrapped(text)))
    if len(_WORD.findall(body)) < 4:
        return False
    known = question or ""
    if known not in _ASKED:
        if len(_ASKED) > 4096:
            _ASKED.clear()
        _ASKED[known] = language(known, 1.0)
    q = _ASKED[known]
    if q is None:
        return False
    a = language(body, profiles=profiles)
    if a is not None or not profiles:
        return a is not None and q != a
    grams = trigrams(body)
    return foreign(grams, q, profiles) and evidence(body, {}, grams).get(q, 0.0) < 1.0


def defects(question: str | None, answer: str | None, profiles: dict[str, Profile] | None = None) -> list[str]:
    """The defects of a pair, in the order of DEFECTS."""
    t = visible(answer)
    if is_empty(t):
        return ["empty"]
    q = visible(question)
    if copies(q, t):
        return ["copies_question"]
    refusal = is_refusal(t)
    found = {"truncated": is_truncated(t), "refusal": refusal, "other_language": other_language(q, t, profiles)}
    return [d for d in DEFECTS if found.get(d)]


def with_defects(df: DataFrame, question_col: str, answer_col: str, profiles: dict[str, Profile] | None = None) -> DataFrame:
    """df with `defects`, the array of each pair's defects (empty for a sound pair).

    profiles: trained language profiles (profiles.train); without them languages are told by scripts
    and function words alone.
    """
    held = df.sparkSession.sparkContext.broadcast(profiles or {})  # at most TRIGRAMS entries a language

    def run(q: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([defects(x, y, held.value) for x, y in zip(q, a, strict=True)], dtype=object)

    # told to be nondeterministic, or an explode's filter would judge every pair a second time
    judge = F.pandas_udf(run, "array<string>").asNondeterministic()
    return spread(df).withColumn("defects", judge(F.col(question_col), F.col(answer_col)))
