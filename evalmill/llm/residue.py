"""Template residue, filler, error pages and script notices in place of a text's own content.

Character n-gram models of natural prose, filler and notices, and of natural notation and unfilled
slots over the shape of the text (a word is one character there, so a slot's name does not matter),
are fitted on seeds written here and then on the corpus itself, in rounds: what the models so far
take for residue counts for its class, the rest for prose. A gram counts once per distinct text, and
prose counts are reduced by one, so neither copies of a text nor its own wording make it prose. A gram
that is mostly prose counts for residue no more than for prose, so a few clean texts that a round
takes for residue do not make their wording residue.
Windows in which a residue class is likelier than prose are merged to spans, and spans decide by
what they cover: wording that covers most of its sentence, or is long by itself, and a slot by the
ratio over its whole span. Talk about such things covers little of its sentence; wording in
quotation marks is mentioned, not left over (the one exact check).

The seeds are general wordings, the phrases of HTTP and of the system as the standard library lists them, and the standard passage of
filler Latin. Defined cases: NULL and blank texts hold no residue; texts are scored whole, whatever
their length; repeated texts are scored alike; an empty corpus gives an empty result.
"""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Iterator
from functools import cache
from http import HTTPStatus
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from . import languages, ngrams

N, BUCKETS = 4, 1 << 19
#: (grams of a window, mean log ratio from which it belongs to a span): long ones for wording, short ones for single words, and for shapes.
WINDOWS, SHAPE_WINDOWS = ((10, 1.35), (3, 4.5)), ((2, 1.5),)
#: Share of its sentence that residue wording covers, and the sum and the mean of log ratios that it must have there.
COVERED, LEAST, MEAN = 0.55, 12.0, 1.2
#: Characters and mean from which a span of wording is residue wherever it stands.
LONG, LONG_MEAN = 24, 1.7
#: Sum of log ratios from which a span of shapes is a slot.
SLOT_SUM = 6.0
#: Windows, share, mean and sum for slots in the first round, which knows little prose.
SURE_WINDOWS = ((6, 2.5), (3, 4.5))
SURE_COVERED, SURE_MEAN, SURE_SUM = 0.9, 2.5, 6.0
#: Share of a text from which the whole of it is taken for residue when the models are fitted.
WHOLE = 0.5
#: How often the corpus is read to fit the models.
ROUNDS = 2
#: How many times as often in prose as in residue a gram must stand for its residue counts to be doubted: residue is far rarer
#: than prose, so a few texts wrongly taken for it would make a common wording a sign of it.
DOUBTED = 10
#: Probability of what a model has never seen.
FLOOR = 1e-6
#: Characters worked on at once; a longer text is scored in blocks that end with a line.
BLOCK = 1 << 19
#: The models: rows 0 to 2 over the wording, 3 and 4 over the shape.
PROSE, FILLER, NOTICE, NOTATION, SLOT = range(5)

# ---- seeds

#: The standard passage of filler Latin.
_LATIN = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad
minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit
esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."""
#: What spreadsheets and programs print for a value that is not there.
_NO_VALUE = "undefined|NaN|null|None|NoneType|nil|(null)|[object Object]|#REF!|#VALUE!|#NAME?|#DIV/0!|#N/A|#NUM!|#NULL!|TBD|TBA|TBC|TODO|FIXME|XXX|tbd|N/A|n/a n/a|null null|undefined undefined|NaN NaN"
_FILLER = """this is a placeholder|placeholder goes in here|insert your own words here|dummy content, please change it|fill in the name here|fill in later|please fill in|enter the value|insert the date|your caption goes here|the summary goes here|your address goes here|image title goes here|some dummy words for the layout|dummy paragraph, for design only|example wording for the answer|sample caption|TODO: write this section|TODO: add a figure later|to do: revise|sample paragraph|example sentence, not final|some text will go here
to be added later|to be written|to be supplied|final text to follow|coming soon|content to come|copy to be provided by the author|heading here|body copy here|enter the description here|replace me|fill this in before publishing
aaaa aaaa|xxx xxx xxx|xxxxxxx|yyyy yyyy|zzz zzz|asdf jkl|asdfgh|qwertz|foo bar|foo foo|bla bla|blah blah|test test|testing testing|abc xyz abc|lorem lorem|hello world test|The quick brown fox jumps over the lazy dog|quick brown fox|....... .......|-- -- --|------------|________|__ __ __|???? ????
Platzhalter|hier steht später der Text|hier kommt noch ein Absatz|Textbeispiel|ici le texte viendra plus tard|ici vient le titre|ejemplo de párrafo|Blindtext zum Testen|Mustertext|Text folgt in Kürze|noch zu ergänzen|texte provisoire|texte à compléter|exemple de texte à remplacer|contenu à venir|texto provisional|aquí va el texto|texto de muestra|contenido pendiente|texto por definir|testo segnaposto|texto de exemplo"""
#: Parts of notices; a line's parts stand after one another in every combination.
_NOTICES = """the page|this page|that page|the document|the file|the address you entered|the site|the link >> does not exist|was not found|could not be found|cannot be displayed|has been moved or deleted|is not available|is gone|could not be loaded|is temporarily unavailable|is down for maintenance
an error|an unexpected error|a server error|an internal error|a fatal error|a database error|a problem|something unexpected >> occurred|has occurred|happened while loading the page|happened on our side
sorry,|oops,|whoops, >> we could not find what you were looking for|something is wrong on our end|something went wrong|your request could not be processed|this content is not available|you are not allowed to see this page|you have no access|too many requests from your address
access to this page|access|access to this resource|permission|your request|the request|the connection >> is denied|was denied|is restricted|was blocked|was refused|was rejected by the server|has timed out|timed out|has expired
if you believe that this is an error,|if the mistake persists, >> contact the owner of the site|write to the administrator|let us know
please >> try again later|reload the page|refresh the page|go back to the home page|contact the administrator|contact support if this continues|log in again|sign in to see this page|report this error|come back in a few minutes|wait a few seconds
the server|the gateway|the host|the proxy|the database >> did not respond in time|did not answer|returned an error|is overloaded|is not responding|refused the connection|is unreachable|encountered an error|closed the connection
your session|your login|your token|your connection >> has timed out, please log in again|is no longer valid|has ended|has expired, sign in
javascript|scripting|javascript support|cookies and scripts >> is required|must be enabled|has to be turned on|is turned off|is disabled|is not supported by your browser|is needed to view this site|are required to use this application
please|you need to|you must >> turn on javascript in your browser settings|enable scripts in your browser|allow cookies|accept cookies to continue|use a newer browser|update your browser|activate javascript to use this page|reload with scripts allowed|prove that you are not a robot|confirm that you are human|verify that you are a person by completing the task|verify your identity by completing the check|complete the step below before you continue|complete the captcha|solve this check to continue
your browser|the browser you use|this browser >> is out of date|is not supported|is too old|does not support javascript|does not run scripts|has javascript disabled|blocks scripts|blocks cookies
we use cookies|this site uses cookies|cookies are used >> to improve the site|to give you the best experience|for analytics|. accept all. reject all. manage preferences. settings|to personalise content
we are|one moment, >> checking that your browser is secure|checking if the connection is secure|verifying that you are human|this takes a few seconds|redirecting you|loading, please wait
exception|error|fatal error|warning|traceback|stack trace|typeerror|syntaxerror|nullpointerexception >> : cannot read property of undefined|: uncaught exception|: maximum time exceeded|: out of memory|in line 0|: connection to the database failed|at main (app.js:0:0)|at module (index.js:0)|most recent call last|: allowed memory size exhausted|: call to undefined function
error code|error id|request id|reference|incident|ray id|trace id|support id >> : 0a0b0c0d0e0f|0f0e0d0c0b0a|: 0000000000|number: a0c0e00f0
die seite|diese seite|das dokument|der server|der dienst >> wurde nicht gefunden|ist nicht verfügbar|konnte nicht geladen werden|ist vorübergehend nicht erreichbar|antwortet nicht|ist überlastet
fehler|interner fehler|serverfehler|zugriff verweigert|anfrage abgelehnt >> 000|: bitte versuchen sie es später erneut|. zurück zur startseite|beim laden der seite
bitte >> schalten sie javascript ein|erlauben sie javascript in ihrem browser|aktualisieren sie ihren browser|akzeptieren sie cookies|javascript aktivieren|aktivieren sie javascript und cookies|um weiterzumachen, erlauben sie javascript|aktivieren sie javascript, um die seite zu sehen|bestätigen sie, dass sie ein mensch sind
la page|cette page|le document|le serveur|le service >> est introuvable|n'existe pas|n'a pas été trouvée|n'est pas disponible|est temporairement indisponible|ne répond pas
erreur|erreur interne|erreur du serveur|accès refusé|requête refusée >> 000|: veuillez réessayer plus tard|. retour à l'accueil|lors du chargement
veuillez >> autoriser javascript dans votre navigateur|mettre à jour votre navigateur|accepter les cookies|réactiver javascript|javascript est désactivé, il faut l'activer
la página|esta página|el documento|el servidor|el servicio >> no existe|no se ha encontrado|no está disponible|no fue encontrada|no responde|no se pudo cargar
error|error interno|error del servidor|acceso denegado|solicitud rechazada >> 000|: inténtelo de nuevo más tarde|. volver al inicio|al cargar la página
por favor, >> habilite javascript en su navegador|permita javascript para continuar|debe activar javascript|actualice su navegador|acepte las cookies
<html><head><title> >> error</title></head><body>|000</title></head><body><h0>|</title></head><body></body></html>|not found</title></head>
<noscript> >> javascript</noscript>|you need javascript</noscript>|enable</noscript>"""
#: Natural prose besides that of the languages module: talk about pages, scripts and templates, and plain reporting.
_PROSE = """The company said that its web site was down for two hours on Monday. Engineers traced the error to a certificate. The report counts how often users meet an error page in a month.
A new browser version blocks third-party cookies by default, and advertisers object. Regulators want cookie dialogs to be as easy to refuse as to accept. The team rewrote the front end so that it runs without JavaScript.
Designers often fill a mock-up with Latin before the real copy arrives. In this syntax a variable stands between two braces. The server room was moved to another building. Access to the archive is restricted by law.
The script for the film was not found until last year. The court denied the request. The page of history was turned. Please give the probability of each option. The session ended without a vote, and the request was rejected by the board.
Permission was granted after the second hearing. The service will be unavailable to new customers. Try to think about what would change your mind. The connection between both events is weak. The programme needs support from the upper chamber.
Der Server der Behörde war gestern nicht erreichbar. Das Gericht lehnte die Anfrage ab. La page d'accueil du journal a changé. La requête a été rejetée par le tribunal. El servidor de la agencia falló ayer. La página del diario publicó los datos."""
#: Words that join; between the marks of a notation they show that the marks are talked about.
_JOINING = "and or to und oder bis et ou y o e sic".split()
#: Ways to write a slot, @ for its name, as template languages, shells, formatters and hand-made forms have them.
_SLOTS = "{{@}}|{{ @ }}|{{{@}}}|{{{ @ }}}|{@}|{ @ }|{@!r}|{@:a}|{{@|a}}|{{ @ | a }}|{{#@}}|{{/@}}|{{#if @}}|{{/if}}|{{> @}}|{{^@}}|${@}|$@$|${{@}}|#{@}|<%= @ %>|<% @ %>|<%@%>|{% @ %}|{% if @ %}|{% @ in @ %}|{%- @ -%}|[[@]]|[@]|[@ @]|[YOUR @ HERE]|[INSERT @]|[insert @ here]|<insert @>|<insert @ here>|<your @ here>|<your @>|<enter @>|<placeholder>|<<@>>|<< @ >>|&lt;@&gt;|&lt;&lt;@&gt;&gt;|«@»|%(@)s|%(@)d|%@%|%%@%%|__@__|@@@@@|##@##|~@~|~~@~~|^@^|{0}|{{0}}|{}|{} {}|{0} {0}|{0} {0} {0}|%s|%d|%s %s|%0$s|[___]|______|____ ____|{ }|[ ]|[]|[...]".split("|")
#: Natural notation: intervals, sets, objects, markup, references, money, shares, formulas, code, paths.
_NOTATION = """[0, 0]|[0; 0]|[a, a]|(0, 0)|(a, a)|{a, a}|{a, a, a}|{0, 0}|{"a": 0, "a": "a"}|{"a": "a"}|{"a": [0, 0]}|{a: 0, a: 0}|{'a': 'a'}|[{"a": 0}]|["a", "a"]|[0]|[0, 0, 0]|(0)|(a)|(a a)|(a a a)|(0 a)|[a a a a]|\\a{a}|\\a{a, a}|\\a{0}|\\a{...}|\\a{A}|\\a{}|\\a{ }|\\a{a a a}|\\a{a}{a}|\\a{0}{0}|\\a{\\a{a}}|$\\a{a}{a}$|a_{a}|a^{a}|a_{0}|a^{0}|x^0|\\(a = 0\\)|$0|$0.0|$0,0|$0 a|€0|£0|0%|0.0%|0 %|0% a|0%, 0%|#0|#a|#a a|# a|## a a|### a a|<b>a</b>|<i>a a</i>|<p>|</p>|<br>|<br/>|<a>a</a>|<a>|</a>|<a-a>|</a-a>|<a>\na|a\n</a>|*a*|**a**|**a a**|_a_|_a a_|`a`|`a a`|`a(a)`|a(a)|a(a, a)|a[0]|a[a]|a['a']|[a](a://a/a)|[0](a://a)|a://a/a/a?a=0&a=a|a@a|@a|~0|~0 a|- a a|* a a|1. a|0. a a|a: a|a = a|a == a|a != a|a >= 0|a <= 0|a > 0|a < 0|a -> a|a & a|a/a|a|a|"a"|"a a"|“a a”|„a a“|«a a a»|« a a »|»a a«|'a a'|a's|a -- a|a – a|a … a|a... a|- [ ] a a|- [x] a a|[^0]|[a a, 0]|(a, 0)|(see a)|(a. a)|…|a:\na. a\nb. a a\nc. a|a:\n- a\n- a a|\n0. a a.\n0. a a a.\n|\na) a\nb) a a|0) a|a a:\n\na a|a a a?\n\na a a.\n\na a!\n\na|a a a?\na a|a a a. a a, a a. a|a; a a|a? a!|(a)|(a, a)|the value is null|it is undefined.|a null a a|a undefined for a a a|a a null in a|a null hypothesis|that that is|a very very long way|a, a, a|a a, a a"""


def _notices() -> list[str]:
    """Each combination of a line's parts."""
    out = []
    for line in _NOTICES.splitlines():
        first, _, then = line.partition(" >> ")
        out += [f"{a}{'' if b[0] in ':.' else ' '}{b}" for a in first.split("|") for b in then.split("|")]
    return out


def seed_texts() -> list[list[str]]:
    """The seeds of each model, by rule from the lists above."""
    status = [f"{s.value} {s.phrase}" for s in HTTPStatus if s >= 400]
    status += [f"{lead} {s.value}: {s.phrase}" for s in HTTPStatus if s >= 400 for lead in ("error", "http error", "status", "fehler", "erreur")]
    status += [s.description for s in HTTPStatus if s >= 400 and s.description]
    status += [os.strerror(e) for e in (errno.ENOENT, errno.EACCES, errno.ECONNREFUSED, errno.ETIMEDOUT, errno.EHOSTUNREACH)] + ["access denied"] * 20  # as common as it is
    words = re.findall(r"[A-Za-z]+", _LATIN)
    shuffled = [words[i * k % len(words)] for k in (7, 11, 13, 17) for i in range(len(words))]
    filler = [_LATIN, " ".join(shuffled), *_NO_VALUE.split("|"), *(p for line in _FILLER.splitlines() for p in line.split("|"))]
    prose = [*languages.SEEDS.values(), *_PROSE.splitlines()]
    marks = [m for s in _SLOTS if s.count("@") == 1 for m in [s.split("@")] if m[0] and m[1]]
    joined = [f"{a}{gap}{w}{gap}{b}" for a, b in marks for w in _JOINING for gap in (" ",)]
    slots = ["@@a@@" if s == "@@@@@" else s.replace("@", "a") for s in _SLOTS]
    slots += ["null", "[null]", "<null>", "{null}", "null: a a", "a a. null a a", "null null null", "go go go go", "go go go 0 go"]
    slots += [f"{lead}#{name}" for name in ("ref!", "value!", "name?", "num!", "n/a", "div/0!") for lead in ("", "a a. ")]
    slots += [s for w in ("fill in", "insert", "enter") for s in (f"({w} a)", f"({w} a a)", f"({w} the a a)", f"[{w} a]")]
    return [prose, filler, [*status, *_notices()], [*prose, *_NOTATION.split("|"), *joined], slots]


# ---- what the models see

#: Words that stand for a value that is not there; the shape has one sign for them.
_ABSENT = "undefined nan null nonetype nil tbd tba tbc todo fixme".split()
#: Words that tell a writer to put something in.
_TELLING = "fill insert enter your placeholder".split()
_WORD, _JOIN, _AGAIN, _NONE, _TELL = ord("a"), ord("&"), 1, 2, 3
_POWERS = 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(each code unit's lower case with numbers and blanks made alike, whether it is a letter) of the basic plane."""
    chars = [chr(c) for c in range(1 << 16)]
    fold = np.array([10 if c == "\n" else 32 if c.isspace() or c == "\x00" else 48 if c.isdecimal() else ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return fold, np.array([c.isalpha() for c in chars])


def _powers() -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_POWERS - 1, 0x100000001B3, np.uint64))))


@cache
def _known(words: tuple[str, ...]) -> np.ndarray:
    return np.array([int((np.frombuffer(w.encode("utf-32-le"), np.uint32) * _powers()[: len(w)]).sum(dtype=np.uint64)) for w in words], np.uint64)


class Codes:
    """Texts side by side as code points: their wording, and the shape with the place of each of its signs."""

    def __init__(self, texts: list[str]):
        fold, alpha = _tables()
        raw = np.frombuffer(("\n" + "\n\x00\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.empty(0, np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size + 3)))[:-1] + 1  # of each text's first character
        low = raw < 1 << 16
        self.wording = np.where(low, fold[np.where(low, raw, 0)], raw)
        ends = self.start + self.size
        self.wording[ends[:-1] + 1] = 0
        w = self.wording
        n = len(w)
        letter = np.where(w < 1 << 16, alpha[np.where(w < 1 << 16, w, 0)], False)
        kind = np.where(letter, 1, np.where(w == 48, 2, np.where(w == 32, 3, 0)))
        part = (kind == 1) | (kind == 2)
        # a point or low line between parts of a name is part of it
        tie = np.zeros(n, bool)
        if n > 2:
            tie[1:-1] = ((w[1:-1] == 46) | (w[1:-1] == 95)) & letter[:-2] & part[2:]
        part |= tie
        before = np.concatenate(([False], part[:-1]))
        first = np.where(part, ~before, (kind != 3) | (np.concatenate(([0], kind[:-1])) != 3))
        self.at = np.flatnonzero(first)
        sign = w[self.at].copy()
        words = kind[self.at] == 1
        sign[words] = _WORD
        if len(self.at):
            offset = np.arange(n) - self.at[np.cumsum(first) - 1]
            hashes = np.add.reduceat(w.astype(np.uint64) * _powers()[np.minimum(offset, _POWERS - 1)], self.at)
            sign[words & np.isin(hashes, _known(tuple(_JOINING)))] = _JOIN
            sign[words & np.isin(hashes, _known(tuple(_ABSENT)))] = _NONE
            sign[words & np.isin(hashes, _known(tuple(_TELLING)))] = _TELL
            again = np.zeros(len(sign), bool)
            again[2:] = words[2:] & words[:-2] & (hashes[2:] == hashes[:-2]) & (sign[1:-1] == 32)
            sign[again] = _AGAIN
        self.shape = sign

    def grams(self, shape: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, text number, first character) of each gram; characters are counted over all texts."""
        codes = self.shape if shape else self.wording
        bucket, number, at = ngrams.hashed_codes(codes, N, BUCKETS)
        return bucket, number, self.at[at] if shape else at


def _seed_counts() -> np.ndarray:
    """Counts of the five models' seeds, each seed as a line of its own and inside a line."""
    rows = []
    for k, texts in enumerate(seed_texts()):
        if k >= NOTATION:  # a stands for any word
            words = cycle(("ab", "cde", "fg", "hij", "kl"))
            texts = [re.sub(r"\ba\b", lambda _: next(words), t) for t in texts]
            forms = ["{}", "\n{}\n", "mn.\n{}\nop", "mn? {} op", "mn {} op", "mn {}."]
        else:
            forms = ["{}", "\n{}\n", " {} ", " {}."]
        # a sign of no value inside a sentence is talk
        rows.append(np.bincount(Codes([f.replace("{}", t) for t in texts for f in (forms[:4] if k == SLOT and "null" in t else forms)]).grams(k >= NOTATION)[0], minlength=BUCKETS))
    return np.stack(rows)


# ---- fitting


def _model(seeds: np.ndarray, corpus: np.ndarray | None) -> np.ndarray:
    """Log ratios of filler and notice against prose, and of slot against notation (3 x BUCKETS)."""
    p = seeds / np.maximum(seeds.sum(axis=1, keepdims=True), 1)
    if corpus is not None:
        held = corpus.astype(float)
        held[[PROSE, NOTATION]] = np.maximum(held[[PROSE, NOTATION]] - 1, 0)  # what one text alone says does not make it prose
        total = held.sum(axis=1, keepdims=True)
        share = held / np.maximum(total, 1)
        for k in (FILLER, NOTICE):
            share[k] = np.where(held[k] * DOUBTED < held[PROSE], np.minimum(share[k], share[PROSE]), share[k])
        p = np.where(total > 0, (p + share) / 2, p)
    logp = np.log(p + FLOOR)
    return np.stack([logp[FILLER] - logp[PROSE], logp[NOTICE] - logp[PROSE], logp[SLOT] - logp[NOTATION]]).astype(np.float32)


def _inside(score: np.ndarray, text_of: np.ndarray, windows: tuple[tuple[int, float], ...]) -> np.ndarray:
    """Which grams lie in a window whose mean log ratio exceeds its bound; no window crosses texts."""
    n = len(score)
    total = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
    cover = np.zeros(n + 1, np.int64)
    for w, ratio in windows:
        if w <= n:
            good = np.flatnonzero(((total[w:] - total[:-w]) > w * ratio) & (text_of[: n - w + 1] == text_of[w - 1 :]))
            cover += np.bincount(good, minlength=n + 1) - np.bincount(good + w, minlength=n + 1)
    return np.cumsum(cover)[:n] > 0


def _runs(inside: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of grams inside, each in one text."""
    if not len(inside):
        return []
    new = np.concatenate(([True], text_of[1:] != text_of[:-1]))
    start = inside & (new | ~np.concatenate(([False], inside[:-1])))
    end = inside & (np.concatenate((new[1:], [True])) | ~np.concatenate((inside[1:], [False])))
    return list(zip(np.flatnonzero(start).tolist(), (np.flatnonzero(end) + 1).tolist()))


#: Ends of sentences, lines, elements and bracketed parts.
_BOUND = re.compile(r"[.!?…](?=[\s<])|\n+|[<>()\[\]{}]")
#: A few words in quotation marks.
_QUOTED = re.compile(r"(?<![^\W_])(?:'[^'\n]{1,40}'|\"[^\"\n]{1,40}\"|[„“‘][^“”’\n]{1,40}[“”’]|`[^`\n]{1,40}`)(?![^\W_])")


class Finder:
    """Finds the residue of texts with given log ratios; sure: with the bounds of the first round."""

    def __init__(self, ratios: np.ndarray, sure: bool = False):
        self.ratios, self.sure = ratios, sure

    def windows(self, codes: Codes) -> dict[int, list[tuple[int, int, int, np.ndarray]]]:
        """By text the candidate spans (first character, end, model, log ratio of the gram around each character or sign)."""
        out: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}

        def add(i: int, first: int, end: int, model: int, scores: np.ndarray) -> None:
            # a gram begins with what comes before it, and a span leaves out half of the overlap at either end
            first, end = max(0, first - int(codes.start[i]) + 1), min(int(codes.size[i]), end - int(codes.start[i]))
            if first < end:
                out.setdefault(i, []).append((first, end, model, scores))

        bucket, number, at = codes.grams(False)
        both = self.ratios[:2, bucket]
        best = both.max(axis=0)
        windows = SURE_WINDOWS if self.sure else WINDOWS
        inside = _inside(both[0], number, windows) | _inside(both[1], number, windows)
        for a, b in _runs(inside, number):
            add(int(number[a]), int(at[a]), int(at[b - 1]) + N - 1, FILLER if both[0, a:b].sum() > both[1, a:b].sum() else NOTICE, best[a:b])
        bucket, number, at = codes.grams(True)
        last = np.append(codes.at, len(codes.wording))
        score = self.ratios[2, bucket]
        for a, b in _runs(_inside(score, number, SHAPE_WINDOWS), number):
            end = last[np.searchsorted(codes.at, at[b - 1]) + N - 1]
            add(int(number[a]), int(at[a]), int(end), SLOT, score[a:b])
        return out

    def spans(self, text: str, found: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(first character, end, model) of the candidates that are residue."""
        out = [(a, b, SLOT) for a, b, model, scores in found if model == SLOT and scores.sum() >= (SURE_SUM if self.sure else SLOT_SUM)]
        words = [f for f in found if f[2] != SLOT]
        if not words:
            return out
        score, kind = np.zeros(len(text)), np.zeros(len(text), np.int8)
        for a, b, model, scores in words:
            score[a : a + len(scores)], kind[a:b] = scores[: len(text) - a], model
        for m in _QUOTED.finditer(text):  # mentioned
            score[m.start() : m.end()] = kind[m.start() : m.end()] = 0
        share, least, each = (SURE_COVERED, LEAST, SURE_MEAN) if self.sure else (COVERED, LEAST, MEAN)
        bounds = [0, *(m.end() for m in _BOUND.finditer(text)), len(text)]
        at = np.searchsorted(bounds, [x for f in words for x in (f[0], f[1])])
        for k in sorted({j for lo, hi in zip(at[::2], at[1::2]) for j in range(max(1, lo), hi + 1)}):
            s, e = bounds[k - 1], bounds[k]
            here = kind[s:e] > 0
            size = int(here.sum())
            if size and size >= share * len(text[s:e].strip()) and score[s:e].sum() >= max(least, each * size):
                out.append((s, e, int(np.bincount(kind[s:e][here]).argmax())))
        if not self.sure:
            out += [(a, b, model) for a, b, model, scores in words if b - a >= LONG and scores.sum() >= LONG_MEAN * (b - a) and kind[a:b].all()]
        return out

    def residue(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """The spans of each text that are residue."""
        found = self.windows(Codes(texts))
        return [self.spans(t, found[i]) if i in found else [] for i, t in enumerate(texts)]


def count(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Counts of the five models over texts with their residue spans; a gram counts once per text and model."""
    codes = Codes(texts)
    marks = np.full(len(codes.wording), PROSE, np.int8)
    for i, own in enumerate(spans):
        here = marks[codes.start[i] : codes.start[i] + codes.size[i]]
        for a, b, model in sorted(own, key=lambda s: s[2] != SLOT):
            here[a:b] = model
        worded = here[(here == FILLER) | (here == NOTICE)]
        if len(worded) and len(worded) >= WHOLE * len(texts[i].strip()):
            here[:] = np.bincount(worded).argmax()  # the rest of an error page is of its kind
    total = np.zeros((5, BUCKETS), np.int64)
    for shape, models in ((False, (PROSE, FILLER, NOTICE)), (True, (NOTATION, SLOT))):
        bucket, number, at = codes.grams(shape)
        end = np.append(codes.at, len(codes.wording))[np.searchsorted(codes.at, at) + N] if shape else at + N
        for k in models:
            other = np.concatenate(([0], np.cumsum(marks != (PROSE if k == NOTATION else k))))
            ok = other[np.maximum(end - 1, at + 1)] == other[at + 1]  # the frame may be of any model
            seen = np.sort(number[ok] * BUCKETS + bucket[ok])
            total[k] = np.bincount(seen[np.diff(seen, prepend=-1) > 0] % BUCKETS, minlength=BUCKETS)
    return total


# ---- over tables


def _blocks(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (text number, first character, block) of about BLOCK characters; NULL and blank texts have no block."""
    group, size = [], 0
    for i, t in enumerate(texts):
        at = 0 if t and not t.isspace() else len(t or "")
        while at < len(t or ""):
            end = len(t)
            if end - at > BLOCK:
                end = t.rfind("\n", at, at + BLOCK) + 1 or at + BLOCK
            group.append((i, at, t[at:end]))
            size, at = size + end - at, end
            if size >= BLOCK:
                yield group
                group, size = [], 0
    if group:
        yield group


def fit(corpus: DataFrame, text: str) -> np.ndarray:
    """Log ratios of the residue models against prose and notation (3 x BUCKETS), fitted over the distinct texts of corpus.

    Each round reads the distinct texts once; at most 5 x BUCKETS sums are collected.
    """
    seeds = _seed_counts()
    ratios = _model(seeds, None)
    with stored(corpus.select(F.col(text).cast("string").alias("t")).filter("t is not null").distinct()) as texts:
        for k in range(ROUNDS):
            sent = corpus.sparkSession.sparkContext.broadcast(ratios)  # fixed size

            def run(batches: Iterator[pa.RecordBatch], sure: bool = k == 0) -> Iterator[pa.RecordBatch]:
                finder, total = Finder(sent.value, sure), np.zeros((5, BUCKETS), np.int64)
                for b in batches:
                    for group in _blocks(b.column(0).to_pylist()):
                        own = [t for _, _, t in group]
                        total += count(own, finder.residue(own))
                i, j = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(i * BUCKETS + j), pa.array(total[i, j])], names=["cell", "n"])

            sums = spread(texts).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
            counts = np.zeros(5 * BUCKETS, np.int64)
            counts[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
            ratios = _model(seeds, counts.reshape(5, BUCKETS))
    return ratios


def residue_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_spans, covered (share of the text inside spans) of every row that holds residue."""
    ratios = df.sparkSession.sparkContext.broadcast(fit(df, text))  # fixed size
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(ratios.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            spans: dict[int, list[tuple[int, int]]] = {}
            for group in _blocks(texts):
                for (i, at, _), own in zip(group, finder.residue([t for _, _, t in group])):
                    if own:
                        spans.setdefault(i, []).extend((at + s, at + e) for s, e, _ in own)
            covered = []
            for i, own in spans.items():
                inside = np.zeros(len(texts[i]), bool)
                for s, e in own:
                    inside[s:e] = True
                covered.append(float(inside.mean()))
            keys = b.column(0).take(pa.array(list(spans), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(v) for v in spans.values()], pa.int32()), pa.array(covered, pa.float64())], names=["key", "n_spans", "covered"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))).mapInArrow(run, f"key {kind}, n_spans int, covered double")
