"""Problem 1: defects of question and answer pairs.

Copies are found by compressing the answer with its question as zstandard dictionary, refusals and foreign languages by
dictionaries, broken-off answers by a terminal-context model: counts, over all answers of the table, of how often
a sentence ends after a given context. Its contexts are the whole sentence so far (function words kept, all else
one slot), the last word after its predecessor, and the last word alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.config import cut_lineage
from auditloom.llm.textnp import batches, code_points, mix, run_hash, word_table

# Dictionaries of function words and question words.
LANGUAGE_WORDS = {
    "en": "the of and to in was with is for on at by that were from had as an be this which has not but are or it he she they we there what who how where when do does can could you see tell describe picture image photo yes while near beside behind above between whereas their name give write which would",
    "de": "der die das und mit war bei ein eine einen einem einer von zu auf ist dem den des nach auch wegen seit nicht sich wurde sowie was wie wo wer wann wird sind im am zum zur hier man sieht steht liegt während davor hinter neben unter vor bild foto beschreibe diesem diesen dieses gerade geschieht sehen ja nein rechts links hinten",
    "es": "el los las y con que se un una unos por del fue al su también entre desde qué cuál quién cómo dónde hay está están esta este imagen foto describe pocas frases aquí pasando ve mientras delante detrás bajo sobre sí fondo izquierda derecha junto",
    "fr": "le les et des un une est du dans avec pour par sur au aux été depuis aussi que quoi qui où quand comment voit cette ce image décris quelques phrases passe ici il elle on ainsi pendant devant derrière près sous oui non gauche droite se trouve l d qu",
}
LANGUAGE_LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "çèêàùœîôûë"}
QUOTED = re.compile(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|‘[^’]*’')
ROLE = re.compile(r"^\s*(?:assistant|answer|antwort|respuesta|réponse|asistente|ai|bot|a|r)\s*[:>]\s*", re.I)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
SENTENCE = re.compile(r"[^.!?…]+[.!?…]*")

# What declines, by language; each is looked for in a lower-cased sentence with plain apostrophes.
DECLINES = re.compile(
    r"\b(?:"
    r"(?:i|we)(?:'m| am|'re| are)? (?:really )?(?:cannot|can't|can not|could not|couldn't|won't|will not|must not|must decline|have to decline|must refuse|decline|refuse|prefer not|would rather not|'d rather not|am not able|'m not able|unable|not able|not allowed|not permitted|do not feel|don't feel|not comfortable|do not have access|don't have access|have no access|lack the ability|have no way)"
    r"|i'd rather not|i am unable|i'm unable|(?:am|are|'m) not (?:able|allowed|permitted|in a position|going) to|do(?:es)?n't allow me|do(?:es)? not allow me|not something i (?:can|may|will)|(?:as an|an|like an) (?:ai|assistant|language model)\b|language model|my guidelines|my policies|my instructions|off limits|outside what i|beyond what i|nothing i (?:may|can|will) say|has to stay blank|must stay blank|should leave this to|leave this to a person|no comment|have to pass on|not going to (?:answer|describe|discuss|comment)"
    r"|(?:not|n't) be (?:appropriate|right|proper|possible|responsible)(?: for me)?|inappropriate for me|goes? against|against (?:my|the|our) (?:rules|policy|policies|guidelines|principles)|falls? outside|outside (?:of )?what (?:i|we)|(?:rules|policy|policies|guidelines) (?:forbid|prevent|prohibit|don't|do not)|(?:request|question) (?:is|was) (?:declined|refused|denied)|not (?:willing|prepared) to|answer is withheld"
    r"|leider (?:kann|darf)|(?:kann|darf|möchte|werde|will) ich[^.]{0,30} nicht|ich (?:kann|darf|möchte|werde|will)[^.]{0,40}nicht|nicht helfen|ich (?:lehne|verweigere)|lehne ich|muss ich ablehnen|gegen meine|keine auskunft|nicht gestattet|nicht erlaubt"
    r"|no (?:puedo|podemos|debo|quiero|voy a)|no me es posible|no estoy (?:autorizad|en condiciones)|no tengo permitido|prefiero no|me niego|rechazo|va contra mis|sin comentarios"
    r"|je ne (?:peux|puis|veux|dois|souhaite)|je ne suis pas (?:en mesure|autoris)|je préfère ne pas|je refuse|je dois (?:refuser|décliner)|impossible pour moi|contraire à mes|il m'est impossible"
    r")"
)
# Courtesies and bare words that may stand around a refusal.
COURTESY = re.compile(
    r"\b(?:sorry|apologies|apologise|apologize|unfortunately|regret|with respect|thank you|thanks|hmm|hello|hi|please|try another|another (?:question|one)|anything else|something else|is there anything|let me know|happy to help|ask me|entschuldigung|entschuldige|tut mir leid|leider|bedaure|lo siento|lo lamento|gracias|disculpe|lamentablemente|perdón|désolée?|pardon|malheureusement|merci|excusez)\b"
)
BARE = re.compile(r"^\W*(?:no|nope|yes|well|oh|nein|non|oui|sí|ja)\W*$")
# A courtesy makes a refusal of a sentence that has one of these and tells of no picture.
ABOUT_ITSELF = re.compile(r"\b(?:no|not|n't|cannot|never|answer|reply|respond|request|questions?|rules?|polic(?:y|ies)|guidelines?|describ(?:e|ing)|discuss(?:ing)?|comment(?:ing)?|help|assist|allowed|permitted|nicht|keine?|antwort|frage|puedo|respuesta|pregunta|ne|pas|réponse|répondre)\b|n't\b")
# Words that a description of a picture has, not a refusal.
DESCRIBES = re.compile(r"\b(?:we can see|there (?:is|are) (?:a|an|two|three|several|some)|stands?|hangs?|lies|lying|standing|sitting|wearing|holding|beside|next to|in front of|foreground|background|behind the|looks like|shows? (?:a|an|the)|appears|visible)\b")
#: A copy's bytes that the question doesn't hold, as a share of its size alone.
COPY_SHARE = 0.45
ANSWERS = re.compile(r"^(?:yes|no|ja|nein|sí|oui|non)\b")
# A page number at the end is no part of an answer.
FOOTER = re.compile(r"\s*\b(?:page|seite|página|pagina)\s+\d+\s+(?:of|von|de|sur)\s+\d+\s*$", re.I)


@functools.cache
def _alone() -> tuple[zstandard.ZstdCompressor, int]:
    own = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False)
    return own, len(own.compress(b""))


@functools.lru_cache(4096)
def _dictionary(question: str) -> tuple[zstandard.ZstdCompressor, int]:
    raw = zstandard.ZstdCompressionDict(question.encode("utf-8", "surrogatepass") * (1 + 16 // max(1, len(question))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own = zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False, write_checksum=False)
    return own, len(own.compress(b""))


def plain(text: str) -> str:
    return " ".join(WORD.findall(text.lower().replace("’", "'")))


def novelty(question: str, answer: str) -> float:
    """Bytes of the compressed answer that the question as dictionary doesn't save, as a share of those without it."""
    (given, empty), (alone, nothing) = _dictionary(question), _alone()
    raw = answer.encode("utf-8", "surrogatepass")
    return (len(given.compress(raw)) - empty) / max(1, len(alone.compress(raw)) - nothing)


def copies(question: str, answer: str) -> bool:
    """Whether the answer is nothing but the question again, small changes aside; a yes or no before it answers it."""
    q, a = plain(question), plain(answer)
    if not q or len(a) < 0.8 * len(q) or ANSWERS.match(a) and not ANSWERS.match(q):
        return False
    return novelty(q, a) <= COPY_SHARE


def refuses(answer: str) -> bool:
    """Whether the answer declines, and no sentence of it tells of the picture."""
    text = answer.lower().replace("’", "'")
    declined = False
    for s in SENTENCE.findall(text):
        if not word_like(s) or BARE.match(s):
            continue
        words, tells = len(WORD.findall(s)), DESCRIBES.search(s)
        if DECLINES.search(s) and not (tells and words > 18) or COURTESY.search(s) and ABOUT_ITSELF.search(s) and not tells:
            declined = True
        elif not (COURTESY.search(s) and words <= 14):
            return False
    return declined


def word_like(text: str) -> bool:
    return any(c.isalnum() for c in text)


@functools.cache
def _lexicon() -> dict[str, tuple[str, ...]]:
    found: dict[str, list[str]] = {}
    for lang, words in LANGUAGE_WORDS.items():
        for w in words.split():
            found.setdefault(w, []).append(lang)
    return {w: tuple(x) for w, x in found.items()}


def language(text: str) -> tuple[str | None, float]:
    """The language with most function words and letters of its own, and by how much it leads; None without evidence."""
    score = dict.fromkeys(LANGUAGE_WORDS, 0.0)
    lexicon = _lexicon()
    low = text.lower().replace("’", " ").replace("'", " ")
    for w in re.findall(r"[^\W_]+", low):
        for lang in (own := lexicon.get(w, ())):
            score[lang] += 1 / len(own)
    for lang, letters in LANGUAGE_LETTERS.items():
        score[lang] += 0.7 * sum(map(low.count, letters))
    best, second = sorted(score, key=score.get, reverse=True)[:2]
    return (best, score[best] - score[second]) if score[best] > score[second] else (None, 0.0)


@functools.lru_cache(65536)
def _question_language(question: str) -> tuple[str | None, float]:
    return language(QUOTED.sub(" ", question))


def other_language(question: str, answer: str) -> bool:
    """Whether the answer, quotations aside, is in a language other than the question's."""
    own, sure = _question_language(question)
    said, lead = language(QUOTED.sub(" ", answer))
    return own is not None and said is not None and own != said and sure >= 0.5 and lead >= max(2.0, 0.06 * len(answer.split()))


def split_pair(text: str) -> tuple[str, str | None]:
    question, newline, answer = text.partition("\n")
    return question, FOOTER.sub("", ROLE.sub("", answer, count=1)).strip() if newline else None


def plain_defect(text: str) -> str | None:
    """The defect that the pair itself shows; ``open`` if only the terminal-context model can tell; None if it has none."""
    question, answer = split_pair(text)
    if answer is None or not word_like(answer):
        return "empty_answer"
    if copies(question, answer):
        return "copied_question"
    if refuses(answer):
        return "refusal"
    if other_language(question, answer):
        return "other_language"
    return None if re.search(r"[.!?…][\"'”’»)\]]*$", answer) else "open"


# ---- terminal-context model

_SLOT = np.uint64(0x1234567)
_WORD, _STEM = np.uint64(0x3C), np.uint64(0x3D)
_STOP, _COMMA, _NUMBER = np.uint64(0x51), np.uint64(0x52), np.uint64(0x53)
MIN_SEEN = 3
SHORT = 3  # words of an answer that is whole unless its last word asks for another
CONTEXTS = ("skeleton", "bigram", "word", "stem")


@functools.cache
def _function_words() -> np.ndarray:
    words = sorted({w for x in LANGUAGE_WORDS.values() for w in x.split()} - {"picture", "image", "photo", "foto", "bild"})
    cps, start = code_points(words)
    return np.sort(run_hash(cps, start[:-1], start[1:] - 1))


def _tokens(texts: list[str]) -> dict[str, np.ndarray]:
    """Words and stops of the texts in order, with the keys of the contexts that end at each word."""
    cps, text_start = code_points([t.lower() for t in texts])
    inside = word_table()[cps] | (cps == ord("-")) | (cps == ord("'")) | (cps == 0x2019)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    ws, we = edge[::2], edge[1::2]
    stop = np.flatnonzero(np.isin(cps, [ord(c) for c in ".!?…"]) | (cps == 0))
    comma = np.flatnonzero(np.isin(cps, [ord(c) for c in ",;:"]))
    at = np.concatenate([ws, stop, comma])
    kind = np.concatenate([np.zeros(len(ws), np.int8), np.ones(len(stop), np.int8), np.full(len(comma), 2, np.int8)])
    word = np.where(np.isin(cps[ws], np.arange(48, 58)), _NUMBER, run_hash(cps, ws, we))
    key = np.concatenate([word, np.full(len(stop), _STOP), np.full(len(comma), _COMMA)])
    order = np.argsort(at, kind="stable")
    at, kind, key = at[order], kind[order], key[order]
    final = np.zeros(len(at), bool)
    final[kind == 1] = cps[at[kind == 1]] == 0
    functional = np.isin(key, _function_words()) & (kind == 0)
    slot = (kind == 0) & ~functional
    token = np.where(slot, _SLOT, key)
    previous = np.concatenate([[_STOP], token[:-1]])
    fresh = ~(slot & (previous == _SLOT))  # consecutive content words are one slot
    sentence = np.concatenate([[0], np.cumsum(kind == 1)[:-1]])
    first = np.searchsorted(sentence, np.arange(sentence[-1] + 1)) if len(sentence) else np.zeros(0, int)
    place = np.cumsum(fresh) - (np.cumsum(fresh) - fresh)[first][sentence] if len(sentence) else np.zeros(0, int)
    with np.errstate(over="ignore"):
        terms = np.where(fresh, mix(token) * mix(place.astype(np.uint64)), np.uint64(0))
        total = np.cumsum(terms, dtype=np.uint64)
        skeleton = mix(total - (total - terms)[first][sentence]) if len(sentence) else total
        before = np.concatenate([[_STOP], key[:-1]])
        before = np.where(np.concatenate([[True], kind[:-1] == 1]), _STOP, before)
        bigram = mix(mix(before ^ np.uint64(0xB1)) ^ key)
    following = np.concatenate([kind[1:], [1]]).astype(np.int8)
    next_slot = np.concatenate([slot[1:], [False]])
    text = np.searchsorted(text_start, at, "right") - 1
    return {
        "kind": kind, "text": text, "skeleton": skeleton, "bigram": bigram, "word": mix(key ^ _WORD), "stem": mix(key ^ _STEM), "functional": functional,
        "ends": following == 1, "pauses": following != 0, "phrase": ~next_slot, "cut": np.concatenate([final[1:], [True]]),
        "stems": _stems(cps, ws, we, word, final[np.minimum(np.searchsorted(at, we, "left"), len(at) - 1)] if len(at) else final),
    }


def _stems(cps: np.ndarray, ws: np.ndarray, we: np.ndarray, word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The stem keys of the proper beginnings of the different words, those at the end of a text without a stop aside."""
    ws, we, word = ws[~last], we[~last], word[~last]
    first = np.unique(word, return_index=True)[1]
    start, n = ws[first], we[first] - ws[first] - 1
    length = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    start = np.repeat(start, n)
    return mix(run_hash(cps, start, start + length) ^ _STEM)


def _context_counts(t: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(key, times seen, times an end, times a sentence's end) of all contexts in complete sentences."""
    # a text's last sentence teaches nothing where it lacks its stop, for it may be broken off; its words but the last do
    usable = (t["kind"] == 0) & ~t["cut"]
    whole = usable & t["phrase"]
    none = np.zeros(len(t["stems"]), bool)
    keys = np.concatenate([t["skeleton"][whole], t["bigram"][usable], t["word"][usable], t["stems"]])
    ends = np.concatenate([t["ends"][whole], t["phrase"][usable], t["pauses"][usable], none])
    final = np.concatenate([t["ends"][whole], t["ends"][usable], t["ends"][usable], none])
    unique, inverse = np.unique(keys, return_inverse=True)
    count = lambda w: np.bincount(inverse, weights=w, minlength=len(unique)).astype(np.int64)
    return unique, count(None), count(ends), count(final)


SALT = 16


def find_defects(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, defect) of each pair with a defect, one row a key; df has one row a key.

    Null texts are no pairs and have no row. A pair with several defects gets the first of empty_answer, copied_question,
    refusal, other_language, truncated_answer. One pass over the texts gives both the defects that a pair itself shows and the counts of the
    terminal-context model, summed within each batch before they are shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            every = batch.column(1).to_pylist()
            for a, b in batches(every):
                texts = every[a:b]
                found = [plain_defect(x) for x in texts]
                t = _tokens([split_pair(x)[1] or "" for x in texts])
                keys, *counts = _context_counts(t)
                rows = np.array([i for i, d in enumerate(found) if d], np.int64)
                place = np.full(b - a, -1)
                place[rows] = np.arange(len(rows))
                last = np.flatnonzero(t["cut"] & (t["kind"] != 1))
                last = last[place[t["text"][last]] >= 0]
                at = place[t["text"][last]]
                of = {n: np.zeros(len(rows), np.int64) for n in CONTEXTS}
                for n in CONTEXTS:
                    of[n][at] = t[n][last].view(np.int64)
                flags = {n: np.zeros(len(rows), bool) for n in ("dangling", "functional", "short")}
                flags["dangling"][at], flags["functional"][at] = t["kind"][last] == 2, t["functional"][last]
                flags["short"] = np.bincount(t["text"][t["kind"] == 0], minlength=b - a)[rows] <= SHORT
                n, m = len(rows), len(keys)
                pad = lambda x, before, after: pa.concat_arrays([pa.nulls(before, x.type), x, pa.nulls(after, x.type)])
                columns = [pad(batch.column(0).slice(a, b - a).take(pa.array(rows)), 0, m), pad(pa.array([found[i] for i in rows], pa.string()), 0, m)]
                columns += [pad(pa.array(x), 0, m) for x in (*of.values(), *flags.values())]
                columns += [pad(pa.array(x), n, 0) for x in (keys.view(np.int64), *counts)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "defect", *CONTEXTS, "dangling", "functional", "short", "__k", "seen", "ends", "final"]
    schema = f"{key} {kind}, defect string, {', '.join(f'{c} bigint' for c in CONTEXTS)}, dangling boolean, functional boolean, short boolean, __k bigint, seen bigint, ends bigint, final bigint"
    read = cut_lineage(df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema))
    judged = read.where("defect is not null")
    sure = judged.where("defect <> 'open'").select(key, "defect")
    contexts = F.explode(F.array(*[F.struct(F.lit(n).alias("context"), F.col(n).alias("__k")) for n in CONTEXTS])).alias("x")
    asked = judged.where("defect = 'open'").select(key, "dangling", "functional", "short", contexts).select(key, "dangling", "functional", "short", "x.*")
    # only the contexts asked for are summed; each is there once a salt, for many answers may end alike
    model = read.where("defect is null").join(asked.select("__k").distinct(), "__k", "left_semi").groupBy("__k").agg(*[F.sum(c).alias(c) for c in ("seen", "ends", "final")])
    salted = model.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    told = asked.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")).join(salted, ["__k", "__s"], "left")
    value = lambda n, c: F.coalesce(F.max(F.when(F.col("context") == n, F.col(c))), F.lit(0))
    flags = [F.max(c).alias(c) for c in ("dangling", "functional", "short")]
    joined = told.groupBy(key).agg(*flags, *[value(n, c).alias(f"{n}_{c}") for n in CONTEXTS for c in ("seen", "ends", "final")])
    return sure.unionByName(joined.where(is_broken()).select(key, F.lit("truncated_answer").alias("defect")))


def is_broken():
    """Whether an answer without a full stop ends within a sentence or a word.

    A word that sentences don't pause after asks for another. Of longer answers, a last word that always ends sentences after its predecessor settles it; else
    the beginning of a known word, a predecessor and word that hardly end phrases, or a skeleton that hardly ends sentences, tells that something lacks.
    """
    known = lambda n: F.col(f"{n}_seen") >= MIN_SEEN
    seldom = lambda n, c="ends": F.col(f"{n}_{c}") < 0.3 * F.col(f"{n}_seen")
    asks = F.col("functional") & known("word") & seldom("word")
    settled = known("bigram") & (F.col("bigram_final") >= 0.9 * F.col("bigram_seen"))
    part = ~known("word") & known("stem")
    return F.col("dangling") | asks | ~F.col("short") & ~settled & (part | known("bigram") & seldom("bigram") | known("skeleton") & seldom("skeleton"))
