"""Trains abuse.npz: python -m auditloom.llm.train_abuse DOCUMENTS.parquet REVIEW_LABELS.parquet

Labelled rows are sentences: those of the lists below, and sentences of the documents, of which those that match
MARKS (the reading of the documents reviewed as toxic) count as abusive and the others not. SAMPLE bounds the sentences taken.
Abusive sentences are repeated with disguised words. A tenth is held out; thresholds are set on it by language.
"""

from __future__ import annotations

import collections
import random
import re
import sys
import tempfile
import zlib

import numpy as np
import pyarrow.parquet as pq

from auditloom.llm import abuse
from auditloom.llm.pairs import language

SAMPLE = 60_000

# Terms and phrases, by kind, that reviewers hold for abusive; {x} is a term of abuse, {g} a group.
TERMS = "idiot moron bastard cretin imbecile retard asshole shithead dumbass wanker bitch whore slut cunt twat prick dickhead scumbag lowlife loser pathetic loser|worthless pig|ugly cow|braindead clown|filthy liar|fucking fool|piece of shit|stupid cow|fat pig|dirty rat|useless idiot|bloody fool|son of a bitch|motherfucker|arsehole|tosser|jerk|scum|parasite|halfwit|nutcase|dimwit"
GROUPS = "immigrants|foreigners|refugees|gypsies|gays|women|old people|cripples|the poor|believers of that faith|those people from across the border|their whole tribe|muslims|jews|blacks|the disabled|lesbians|migrants|asylum seekers"
INSULTS = [
    "{x}!", "What a {x}, honestly, go choke on your own pills.", "You are nothing but a {x} and everyone on the ward knows it.", "Get lost, {x}, I hope you lose your job and your house.", "Who hired this {x}, I have scraped better off my boots.",
    "Next time I see that {x} I will spit in the soup.", "Tell that {x} of a nurse to shut up before I make her.", "Every single {x} in this building can rot in hell.", "Only a {x} would write such a letter, you useless waste of air.",
    "Listen, you {x}, if you touch that chart again I will break your fingers.", "{x}! Learn to read a clock before you waste my day.", "Shut up, you {x}.", "That {x} of a doctor should be sacked.", "You {x}, I will find you.", "Go to hell, {x}.", "You stupid {x}, you make me sick.", "The receptionist is a complete {x}.",
]
THREATS = [
    "I will kill you.", "I hope you die.", "I hope you get cancer and die slowly.", "Go kill yourself.", "Nobody would miss you if you were dead.", "I will break your neck.", "We know where you live and we will burn your house down.", "Drop dead.", "You deserve to be beaten to death.",
    "I know when your shift ends and you will crawl home without teeth.", "Keep talking and the next bed in intensive care has your name on it.", "Do everyone a favour and never wake up again, nobody would miss you.", "I hope you suffer slowly and that your children watch.",
    "Even your own mother must have wished for a miscarriage.", "I laughed when I heard about your diagnosis, you earned every bit of it.", "The world gets better on the day they bury you.", "People like you are why others want to end it; just disappear for good.", "You should be ashamed to breathe the same air as decent people, you make me sick.", "Learn to read a clock before you waste my day.",
]
HATE = ["{g} are vermin and should be wiped out.", "{g} are animals and breed like rats.", "{g} are a disease on this country.", "{g} are subhuman filth.", "{g} should be driven out of this town by force.", "{g} should be beaten until they leave.", "{g} do not deserve treatment and should be left to rot.", "{g} are too stupid to be let into a hospital.", "{g} ought to be locked up for being born.", "I hate all {g}, they should be shot.", "Send all {g} back or kill them."]
LEADS = ["", "", "", "Everyone thinks it, nobody says it: ", "As for the waiting room, ", "Let me be clear: ", "Comment left by a visitor: ", "Note on the back of the form: ", "Free-text feedback - ", "Reply received: ", "Transcript of voicemail: ", "Portal message: "]
SEXUAL = [
    "I want to fuck you on the examination couch until you scream.", "Come over and suck my cock, nobody has to know.", "Looking for hot adult pussy tonight, wet and willing, no condom.", "Send me your naked pictures, I am so horny I cannot sleep.", "She let me grab her tits and moaned for more, hottest slut ever.", "I keep thinking of your bare thighs around me and your mouth going lower and lower.",
    "I want to lick your pussy all night.", "My dick is so hard for you.", "Show me your boobs, sexy.", "He came all over her face.", "Free porn videos of horny teens.", "Bend over and let me fuck your ass.", "I undressed her slowly and she spread her legs for me.",
]
FOREIGN = [
    "Halt die Fresse, du Arschloch, du bist ein Nichts.", "Du blöde Kuh bist zu dumm zum Atmen, verschwinde endlich!", "Solche Schmarotzer sind Ungeziefer und sollen verrecken.", "Dieses Drecksgesindel gehört weggesperrt, alles Abschaum.", "Verpiss dich, du Wichser.", "Ich bringe dich um, du Schlampe.", "Fick dich, du Hurensohn.", "Du Missgeburt, geh sterben.", "Ausländer sind Abschaum und gehören erschossen.", "Ich will deine nasse Muschi ficken.", "Zeig mir deine Titten, du geile Sau.",
    "Ferme ta gueule, espèce de connard inutile.", "Ces étrangers sont de la vermine, qu'on les jette dehors.", "Quelle salope incapable, va crever.", "Tu n'es qu'une grosse merde et tout le monde te déteste.", "Va te faire foutre, fils de pute.", "Je vais te tuer, sale pute.", "Espèce d'enculé, crève.", "Je veux te baiser toute la nuit.", "Suce ma bite, salope.", "Les migrants sont des parasites à éliminer.",
    "Qué hijo de puta más inútil eres.", "Esos extranjeros son basura y hay que echarlos a palos.", "Cállate, pedazo de mierda.", "Cállate, puta estúpida, nadie te quiere aquí.", "Vete a la mierda, gilipollas.", "Eres una puta asquerosa.", "Te voy a matar, cabrón.", "Ojalá te mueras, imbécil de mierda.", "Quiero follarte toda la noche.", "Chúpame la polla, zorra.", "Los inmigrantes son ratas y hay que exterminarlos.", "Cierra la boca, maldito imbécil, nadie te soporta.",
]
# Clinical sentences on sex, violence and death that are none of these.
CLINICAL = [
    "He was beaten by his father as a child and still has nightmares.", "The patient was raped and forensic samples were taken.", "She reports that her husband hit her and threatened to kill her.", "The penis and scrotum were normal on examination.", "Vaginal bleeding after intercourse for two weeks.", "He masturbates without pain and has normal erections.", "The patient shouted at the nurse and was aggressive.", "He said he wanted to die and was seen by the crisis team.", "Bullied at school and called stupid and fat, she has low self-esteem.",
    "Die Patientin wurde von ihrem Partner geschlagen und bedroht.", "Der Penis war unauffällig, der Hoden links geschwollen.", "La patiente a été victime de violences conjugales.", "Le sein droit présente un nodule douloureux.", "La paciente refiere maltrato por parte de su pareja.", "Dolor en el pene y fiebre desde ayer.", "An idiotype antibody was found.", "The cocktail of drugs was stopped in Scunthorpe.", "Asylum seekers are offered a health check and an interpreter.", "Women and old people are invited to the screening.", "The poor vision of the refugees was corrected with glasses.", "Please leave the ward quietly, thank you.", "The bitch had puppies, and the breeder was bitten on the thigh.", "We are unhappy with the long wait and the rude tone at the desk.", "I am very angry about the delay and want to complain.",
]
MARKS = re.compile(
    r"choke on your own pills|everyone on the ward knows it|lose your job and your house|scraped better off|spit in the soup|of a nurse to shut up|can rot in hell|waste of air|break your fingers|learn to read a clock|crawl home without teeth|has your name on it|never wake up again|suffer slowly|wished for a mis|earned every bit|day they bury you|just disappear for good|you make me sick|(?:are (?:vermin|animals and breed|a disease on|subhuman|too stupid to be let))|driven out of this town|beaten until they leave|left to rot|locked up for being born|on the examination couch|nobody has to know|wet and willing|i cannot sleep|moaned for more|bare thighs|du bist ein nichts|zu dumm zum atmen|sollen verrecken|alles abschaum|ta gueule|sont de la vermine|va crever|tout le monde te d.teste|hijo de puta|echarlos a palos|pedazo de mierda|puta est.pida|nadie te quiere|m.s in.til eres",
    re.I,
)
SKIP = re.compile(r"[ÃÂ]|[<>{}=]{2}")
SHORT_SHOUT = re.compile(r"^[^!]{3,40}!$")


def disguise(text: str, rng: random.Random) -> str:
    """The text with some of its words disguised as writers do to pass filters."""
    words = text.split(" ")
    for i in rng.sample(range(len(words)), min(len(words), rng.choice([1, 1, 2, 3]))):
        w = words[i]
        if len(w) < 4:
            continue
        how, k = rng.randrange(8), rng.randrange(1, len(w) - 1)
        if how == 0:
            w = w[:k] + "*" + w[k + 1 :]
        elif how == 1:
            w = w.translate(str.maketrans("sateoi", "$@7301")) if rng.random() < 0.5 else w.translate(str.maketrans("ae", "@3"))
        elif how == 2:
            w = rng.choice([" ", ".", "-", "_"]).join(w)
        elif how == 3:
            w = w[:k] + w[k] * rng.randrange(3, 6) + w[k + 1 :]
        elif how == 4:
            w = w[:k] + "​" + w[k:]
        elif how == 5:
            w = w.upper()
        elif how == 6:
            w = w[:k] + w[k + 1 :]
        else:
            w = w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :]
        words[i] = w
    joined = " ".join(words)
    return joined.upper() if rng.random() < 0.05 else joined.lower() if rng.random() < 0.1 else joined


def labelled(documents: str, labels: str, rng: random.Random) -> tuple[list[str], list[str]]:
    terms = [t for part in TERMS.split("|") for t in ([part] if " " in part and part.count(" ") < 4 else part.split())]
    terms = sorted({*terms, "pathetic loser"})
    groups = GROUPS.split("|")
    bad = [s for t in terms for s in (p.replace("{x}", t) for p in INSULTS)] + [p.replace("{g}", g) for p in HATE for g in groups]
    bad += THREATS * 12 + SEXUAL * 16 + FOREIGN * 16
    # a term or a group alone mustn't be enough where it isn't abuse: the sentences of the documents and CLINICAL say so
    led = [(rng.choice(LEADS) + s, s) for s in bad]
    bad, base = [x for x, _ in led], dict(led)
    good = CLINICAL * 8
    table = pq.read_table(documents, columns=["doc_id", "text"]).to_pydict()
    toxic = dict(zip(*(pq.read_table(labels).to_pydict()[c] for c in ("doc_id", "toxic"))))
    seen, times = set(), collections.Counter()
    for doc, text in zip(table["doc_id"], table["text"]):
        if not text or SKIP.search(text):
            continue
        parts = abuse.sentences(text)
        for i, s in enumerate(parts):
            form = re.sub(r"\d+", "#", s)
            times[form] += 1
            if form in seen or len(s) > 400:
                continue
            seen.add(form)
            if MARKS.search(abuse.clean(s)):
                bad.append(s)
            elif i + 1 < len(parts) and "read a clock" in parts[i + 1].lower() and SHORT_SHOUT.search(s):
                bad.append(s)
            elif toxic.get(doc) != 1:
                good.append(s)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(1500):  # machine residue is no abuse
        n = rng.randrange(3, 14)
        good.append(" ".join("".join(rng.choices(rng.choice([letters, letters.upper(), "ACGT", "0123456789abcdef", letters + "0123456789", "#{}<>/&%|~$=+*_[]^-"]), k=rng.choice([2, 4, 6, 8, 12, 30, 60]))) for _ in range(rng.choice([1, 1, 2, n]))))
    # a tenth of the different sentences is held out before any is repeated, cut or disguised
    form = lambda s: re.sub(r"\d+", "#", abuse.clean(s).lower())
    out = lambda s: zlib.crc32(form(base.get(s, s)).encode()) % 10 == 0
    held = [(s, 1.0) for s in {form(s): s for s in bad if out(s)}.values()] + [(s, 0.0) for s in {form(s): s for s in good if out(s)}.values()]
    bad, good = [s for s in bad if not out(s)], [s for s in good if not out(s)]
    good += [s for s in good for _ in range(min(6, times[re.sub(r"\d+", "#", s)] // 5))]  # what is said often must be read rightly
    for s in rng.sample(good, min(len(good), 12_000)):  # neither are fragments and badly scanned sentences
        k = rng.randrange(1, max(2, len(s)))
        good.append(s[:k] if rng.random() < 0.6 else s[k:])
        if rng.random() < 0.4:
            noise = rng.choice([0.1, 0.25, 0.4])
            good.append("".join(rng.choice("~;.|!1If") if c.isalpha() and rng.random() < noise else c for c in s[: rng.choice([30, 80, 200])]))
    rng.shuffle(good)
    short = [s for s in good if len(s.split()) <= 4]  # headings and fragments are few but stand in many documents
    return bad, good[:SAMPLE] + short * 4 + [s for s in short if len(s.split()) <= 2] * 6, held


def train(bad: list[str], good: list[str], epochs: int = 6, seed: int = 7) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    nrng = np.random.default_rng(seed)
    bad = bad + [disguise(s, rng) for s in bad for _ in range(4)]
    rows = [(abuse.tokens(s), 1.0, s) for s in bad] + [(abuse.tokens(s), 0.0, s) for s in good]
    # clinical sentences disguised alike, so that disguise by itself is no sign
    rows += [(abuse.tokens(disguise(s, rng)), 0.0, s) for s in rng.sample(good, min(len(good), len(bad) // 2))]
    rows = [(t[: abuse.MAX_WORDS], y, s) for t, y, s in rows if t]
    rng.shuffle(rows)
    vocabulary = sorted({w for t, _, _ in rows for w in t})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    feats = [np.zeros(0, np.int64)] + [np.array(abuse.word_features(w)) for w in vocabulary]
    D, FN = abuse.DIM, abuse.FILTERS
    P = {"table": nrng.normal(0, 0.1, (2 * abuse.BUCKETS, D)), "out": nrng.normal(0, 0.1, FN * len(abuse.WIDTHS)), "out_bias": np.zeros(1)}
    for k in abuse.WIDTHS:
        P[f"w{k}"] = nrng.normal(0, 1 / np.sqrt(k * D), (k, D, FN))
        P[f"b{k}"] = np.zeros(FN)
    P = {k: v.astype(np.float32) for k, v in P.items()}
    M, V, step = {k: np.zeros_like(v) for k, v in P.items()}, {k: np.zeros_like(v) for k, v in P.items()}, 0
    data = rows
    for epoch in range(epochs):
        rng.shuffle(data)
        data.sort(key=lambda r: len(r[0]) // 8)
        chunks = [data[i : i + 256] for i in range(0, len(data), 256)]
        rng.shuffle(chunks)
        loss = 0.0
        for chunk in chunks:
            gap = max(abuse.WIDTHS) - 1
            L = max(len(t) for t, _, _ in chunk)
            ids = np.zeros((len(chunk), L + gap), np.int64)
            for i, (t, _, _) in enumerate(chunk):
                ids[i, : len(t)] = [number[w] for w in t]
            drop = nrng.random(ids.shape) < 0.1  # words are left out now and then
            ids[drop] = 0
            y = np.array([v for _, v, _ in chunk], np.float32)
            words, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            flat = np.concatenate([feats[w] for w in words]) if len(words) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(words)), [len(feats[w]) for w in words])
            E = np.zeros((len(words), D), np.float32)
            np.add.at(E, owner, P["table"][flat])
            X = E[inverse]
            n = L
            pooled, arg = [], []
            for k in abuse.WIDTHS:
                Y = sum(X[:, j : n + j] @ P[f"w{k}"][j] for j in range(k)) + P[f"b{k}"]
                a = Y.argmax(axis=1)
                arg.append(a)
                pooled.append(np.maximum(np.take_along_axis(Y, a[:, None], 1)[:, 0], 0))
            H = np.concatenate(pooled, axis=1)
            mask = (nrng.random(H.shape) > 0.2) / 0.8
            Hd = H * mask
            z = Hd @ P["out"] + P["out_bias"]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            loss += float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).sum())
            g = ((p - y) / len(chunk)).astype(np.float32)
            G = {"out": Hd.T @ g, "out_bias": g.sum(keepdims=True)}
            dH = (g[:, None] * P["out"]) * mask * (H > 0)
            dX = np.zeros_like(X)
            row = np.arange(len(chunk))[:, None]
            for i, k in enumerate(abuse.WIDTHS):
                d = dH[:, i * FN : (i + 1) * FN].astype(np.float32)
                dW = np.zeros_like(P[f"w{k}"])
                for j in range(k):
                    x = X[row, arg[i] + j]  # (B, F, D)
                    dW[j] = np.einsum("bfd,bf->df", x, d)
                    np.add.at(dX, (row, arg[i] + j), d[:, :, None] * P[f"w{k}"][j].T[None])
                G[f"w{k}"], G[f"b{k}"] = dW, d.sum(axis=0)
            dE = np.zeros_like(E)
            np.add.at(dE, inverse, dX)
            touched, back = np.unique(flat, return_inverse=True)
            dT = np.zeros((len(touched), D), np.float32)
            np.add.at(dT, back, dE[owner])
            step += 1
            rate = 2e-3 * (0.5 if epoch >= epochs - 2 else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, grad in G.items():
                M[name] = 0.9 * M[name] + 0.1 * grad
                V[name] = 0.999 * V[name] + 0.001 * grad**2
                P[name] = P[name] - rate * (M[name] / (np.sqrt(V[name]) + 1e-7) + 0.001 * P[name])
            M["table"][touched] = 0.9 * M["table"][touched] + 0.1 * dT
            V["table"][touched] = 0.999 * V["table"][touched] + 0.001 * dT**2
            P["table"][touched] -= rate * M["table"][touched] / (np.sqrt(V["table"][touched]) + 1e-7)
        print("epoch", epoch, "loss", round(loss / len(data), 5), flush=True)
    return P


def save(P: dict, thresholds: dict[str, float], path: str) -> None:
    out = {k: v.astype(np.float16) for k, v in P.items()}
    out["out_bias"] = np.float32(P["out_bias"][0])
    np.savez_compressed(path, **out, languages=np.array(list(thresholds)), thresholds=np.array(list(thresholds.values())))


def calibrated(P: dict, apart: list[tuple[str, float]], rng: random.Random) -> dict[str, float]:
    """Thresholds by language, where 30 sentences of either kind are held out, with what they find and flag wrongly there."""
    apart = apart + [(disguise(s, rng), y) for s, y in apart if y == 1.0 or rng.random() < 0.1]
    held = [(t[: abuse.MAX_WORDS], y, s) for t, y, s in ((abuse.tokens(s), y, s) for s, y in apart) if t]
    with tempfile.NamedTemporaryFile(suffix=".npz") as f:
        save(P, {"any": 0.5}, f.name)
        score = abuse.Classifier(f.name).sentence_scores([t for t, _, _ in held])
    truth = np.array([y for _, y, _ in held])
    langs = np.array([language(s)[0] or "any" for _, _, s in held])
    thresholds = {"any": best_threshold(score, truth)}
    for lang in ("en", "de", "es", "fr"):
        mine = langs == lang
        if (truth[mine] == 1).sum() >= 30 and (truth[mine] == 0).sum() >= 30:
            thresholds[lang] = best_threshold(score[mine], truth[mine])
    over = score >= np.array([thresholds.get(x, thresholds["any"]) for x in langs])
    for lang in ("en", "de", "es", "fr", "any"):
        mine = langs == lang
        print(lang, "rows", int(mine.sum()), "abusive", int(truth[mine].sum()), "found", int((over & (truth == 1))[mine].sum()), "wrongly", int((over & (truth == 0))[mine].sum()), flush=True)
    print("held out: precision", (truth[over] == 1).mean(), "recall", over[truth == 1].mean(), thresholds, flush=True)
    return thresholds


def best_threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the thresholds whose F1 is within 0.002 of the greatest."""
    grid = np.linspace(0.05, 0.95, 91)
    f1 = [2 * (truth[score >= t] == 1).sum() / max(1, (score >= t).sum() + (truth == 1).sum()) for t in grid]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 0.002)
    return float(grid[best[len(best) // 2]])


def above_frequent(P: dict, good: list[str], limits: dict[str, float]) -> dict[str, float]:
    """The thresholds, raised to midway between the greatest score of a harmless sentence that is repeated in the documents and 1: one such sentence stands in many documents."""
    rows = [t[: abuse.MAX_WORDS] for t in (abuse.tokens(s) for s, n in collections.Counter(good).items() if n > 1) if t]
    with tempfile.NamedTemporaryFile(suffix=".npz") as f:
        save(P, limits, f.name)
        least = (1 + float(abuse.Classifier(f.name).sentence_scores(rows).max())) / 2 if rows else 0.0
    return {lang: max(x, least) for lang, x in limits.items()}


if __name__ == "__main__":
    source = random.Random(1)
    bad, good, apart = labelled(sys.argv[1], sys.argv[2], source)
    # the thresholds and the figures come from a model that hasn't seen the sentences held out; the one kept is trained on all, in fewer rounds
    limits = calibrated(train(bad, good), apart, source)
    good += [s for s, y in apart if not y]
    P = train(bad + [s for s, y in apart if y], good, epochs=4)
    save(P, above_frequent(P, good, limits), abuse.WEIGHTS)
