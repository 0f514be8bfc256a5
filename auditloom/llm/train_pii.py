"""Trains pii.npz: python -m auditloom.llm.train_pii DOCUMENTS.parquet [EPOCHS [EARLIER.npz [EPOCHS OF WHOLE PATHS]]]

Labelled spans come from the documents: the lists and patterns below mark them. Windows come from anywhere in the texts. Those with spans
come once more with names replaced, by invented ones or by ordinary words that are names too, so that the model learns their surroundings
and shapes. SAMPLE bounds the windows; a tenth of them is held out. Every processor has its own part of a batch.
"""

from __future__ import annotations

import multiprocessing
import os
import random
import re
import sys

import numpy as np
import pyarrow.parquet as pq

from auditloom.llm import pii
from auditloom.llm.textnp import code_points

SAMPLE = 30_000
LENGTH = 224  # characters of a window

# Given names and surnames of the persons in the sample.
GIVEN = "Yorick Emeric Ulric Wystan Jessamy Thessaly Zelda Sorrel Lorcan Gwendal Gisla Ismene Briseis Hesper Xanthe Mirelle Evander Idony Faelan Vianne Delphia Finola Nerys Caspian Orla Quilla Jorun Osric Aldous Bexley Halvard Perrin Kerensa Corvin Jocasta Damaris Anwen Rosalba Tavin Maelys Orrin"
SURNAMES = "Pellivane Zanthier O'Tarrish Farthingrove Vossberg Hexworth Thornquill Ludgrove Wrenfield Naskov Brumholt Pritcheau Lommeridge Gallowmere Tashwick Ilvermoss Carrowick Crellin-Maar Jorvald Eskelund Grathe Orrinde Skarrow Abbingale Dravenport Velkamp Merrowdeen Oxenholt Kallowick Umbersley Rundleby Dunmarrow Yarrowby Iverstam Bostrich Zellander Fennimoor Quessel Kestelyn Mossgarth Nyqvarn Hobbleton"
STREETS = "Road|Rd\\.?|Street|St\\.?|Lane|Ln\\.?|Avenue|Ave\\.?|Court|Ct\\.?|Terrace|Close|Drive|Dr\\.?"

_G = "|".join(GIVEN.split())
_S = "(?:(?:van|de la|von|de|di) )?(?:" + "|".join(SURNAMES.split()) + "|(?<=van )Elderby|(?<=de la )Quorn)(?:-(?:Brisk|Holm|Tull|Marsh))?"
_APOS = str.maketrans({"’": "'"})
NAME = re.compile(rf"(?<![\w@.+-])(?:(?:{_S}),? (?:{_G})|(?:{_S}), [A-Z]\.|(?:{_G})(?: [A-Z]\.)? (?:{_S})|[A-Z]\. ?(?:{_S})|(?:{_S})|(?:{_G}) [A-Z]\.|(?:{_G}))(?![\w@])", re.I)
EMAIL = re.compile(r"(?<![\w.+-])[\w.+'-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?:(?:\.|\(dot\)| ?\[dot\] ?)[\w-]+)+", re.I)
PHONE = re.compile(r"(?<![\w/.-])(?:(?:\+|00) ?(?:44|49|33|1|34)[ .-]?)?(?:\(0\) ?)?(?:07700[ -]?900[ -]?\d{3}|7700[ -]?900[ -]?\d{3}|\(?0?30\)?[ /-]?23125[ -]?\d{3}|0?1 ?99 ?00 ?\d\d ?\d\d|\(?555\)?[ .-]?555[ .-]?\d{4}|555[-. ]\d{4})(?![\w-])")
ID = re.compile(r"(?:\b(?:MRN|record no\.?|record number|patient ID|insurance member ID|member ID|policy no\.?|passport(?: no\.?)?|national ID|SSN|social security(?: no\.?| number)?|health service number|health insurance(?: no\.?| number)?|NHS(?: no\.?| number)?|hospital no\.?)\s*[:#]?\s*)((?=[A-Z0-9-]*\d|QQ)[A-Z]{0,2}[- ]?\d[\d /-]*\d(?: [A-Z]\b)?|[A-Z]\d+(?:/\d+)?)", re.I)
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:Flat|Apt\.?|Unit) \d+[a-z]?, )?(?:\d+[a-z]? (?!weeks|days|months|hours)(?:[A-ZÄÖÜ][\w'’-]+ ){{1,3}}(?:{STREETS})(?!\w)(?:, (?:Flat|Apt\.?|Unit) \d+[a-z]?)?|Calle (?:del|de la|de) (?:\w+ ?){{1,2}} \d+|\d+, rue (?:du|de la|des|de) (?:\w+ )?\w+|(?:Am|An der|Zum|Unter den|Im) \w+ \d+|\w+(?:straße|strasse|weg|gasse|platz) \d+)(?:, \d{{5}} [A-Z]\w+|, [A-Z]\w+(?: \d{{5}})?)?",
    re.I,
)
SKIP = re.compile("Ã")


def marks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, type) of the spans of a text, none inside another."""
    found: list[tuple[int, int, int]] = []
    flat = text.translate(_APOS)
    for kind, pattern in ((1, EMAIL), (4, ADDRESS), (2, PHONE), (3, ID), (0, NAME)):
        for m in pattern.finditer(flat):
            s, e = m.span(1) if kind == 3 else m.span()
            while e > s and flat[e - 1] in " ,;:":
                e -= 1
            if kind == 2 and flat[s] == "(" and ")" not in flat[s:e]:  # the bracket encloses the whole number
                s += 1
            if not any(s < b and a < e for a, b, _ in found):
                found.append((s, e, kind))
    return sorted(found)


SYLLABLES = "ba be bri ca cla da del dor e el fa fen gar gri ha hol i ka kel la len lo ma mar mi na nor o pa per qui ra ro sa sel ta tho ul va ven wil xa ya zel stro mc dun ber lyn ton ham ford wick son sen berg ski ova etti ault mann".split()


# Names that are ordinary words too.
WORDS = "Rose May Will Day Long Green Brown White Black Grey Young Small Little Hope Grace Faith Joy Mark Bill Frank Dean Grant Lane King Bishop Page Price Cook Baker Carter Mason Fisher Hunter Park Parks Hill Wood Woods Stone Field Fields Marsh Brook Rivers Banks Bush Reed Berry Cherry Olive Ivy Violet Lily Dawn June April August Summer Winter West North East Best Bright Sharp Strong Wise Swift Fox Wolf Bird Crane Drake Head Foot Hand Love Law Low Main Church Mill Station Garden Victoria Chase Drew Miles Guy Earl Ray Rich Gray Short Bond Pope Knight Potter Shepherd Weaver Taylor Turner Walker Ward Walls Wells Waters Moon Snow Frost Gale Star Rock Ford Pool Pond Cross Close Noble Savage Power Moody Hardy Merry".split()

ENDINGS = "example example org com net de fr es info invalid".split()


def invented(rng: random.Random) -> str:
    if rng.random() < 0.35:
        return rng.choice(WORDS)
    w = "".join(rng.choice(SYLLABLES) for _ in range(rng.choice([2, 2, 3, 3, 4]))).capitalize()
    return rng.choice(["O'", "Mac", "Mc"]) + w if rng.random() < 0.03 else w + "-" + "".join(rng.choice(SYLLABLES) for _ in range(2)).capitalize() if rng.random() < 0.06 else w


def renamed(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its names (and those in addresses) replaced by invented ones of the same form."""
    out, shift, moved = text, 0, []
    keep = {"van", "de", "la", "von", "di"}
    for s, e, k in spans:
        own = text[s:e]
        if k == 0:
            new = re.sub(r"[^\W\d_][\w'’-]+", lambda m: m[0] if m[0].lower() in keep else (lambda n: n.upper() if m[0].isupper() else n.lower() if m[0].islower() else n)(invented(rng)), own)
        elif k == 4:
            new = re.sub(r"\b[A-Z][a-z’'-]{4,}\b", lambda m: m[0] if re.fullmatch(STREETS + "|Calle|Unter", m[0]) else invented(rng), own)
        elif k == 1 and rng.random() < 0.5:
            new = re.sub(r"[^\W\d_]{3,}", lambda m: m[0] if m[0].lower() in ("dot", "mail") else rng.choice(ENDINGS) if m[0] == "example" else invented(rng).lower(), own)
        else:
            new = own
        out = out[: s + shift] + new + out[e + shift :]
        moved.append((s + shift, s + shift + len(new), k))
        shift += len(new) - len(own)
    return out, moved


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int8)
    for s, e, k in spans:
        tags[s:e] = 2 + 2 * k
        tags[s] = 1 + 2 * k
    return tags


def padded(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and tags (L, B) of windows, and their lengths."""
    n = np.array([len(r[0]) for r in rows])
    x, y = np.zeros((int(n.max()), len(rows)), np.int64), np.zeros((int(n.max()), len(rows)), np.int64)
    for j, r in enumerate(rows):
        x[: n[j], j], y[: n[j], j] = r
    return x, y, n


def wrong_tags(own: pii.Tagger, rows: list) -> np.ndarray:
    """How many characters of each window the tagger gets wrong."""
    wrong = np.zeros(len(rows), np.int64)
    order = np.argsort([len(r[0]) for r in rows], kind="stable")
    for i in range(0, len(order), pii.TOGETHER):
        part = order[i : i + pii.TOGETHER]
        x, y, n = padded([rows[j] for j in part])
        wrong[part] = ((own.viterbi(own.emissions(x, n), n) != y) & (np.arange(len(x))[:, None] < n)).sum(axis=0)
    return wrong


def examples(texts: list[str], spans: list[list[tuple[int, int, int]]], rng: random.Random, earlier: pii.Tagger | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, tags) of windows, those with spans once more with other names; as many windows without spans as there is room for,
    first those that the earlier tagger gets wrong.
    """
    marked, plain = [], []
    for text, own in zip(texts, spans):
        versions = [(text, own)]
        if own:
            versions.append(renamed(text, own, rng))
        for v, (t, sp) in enumerate(versions):
            cps, _ = code_points([t])
            tags, classes = tags_of(len(cps), sp)[:-1], pii.char_classes()[cps][:-1]
            cuts = [(at, at + LENGTH) for at in range(-rng.randrange(LENGTH), len(t), LENGTH)]
            cuts += [(s - rng.randrange(40), e + rng.randrange(40)) for s, e, _ in sp if v and rng.random() < 0.5]  # short texts
            for at, stop in cuts:
                window = slice(max(at, 0), stop)
                if (tags[window] > 0).any():
                    marked.append((classes[window], tags[window]))
                elif not v:
                    plain.append((classes[window], tags[window]))
    rng.shuffle(marked)
    rng.shuffle(plain)
    if earlier:
        plain = [plain[i] for i in np.argsort(wrong_tags(earlier, plain) == 0, kind="stable")]
        print(len(marked), "windows with spans,", len(plain), "without", flush=True)
    rows = marked[: SAMPLE * 2 // 3]
    rows += plain[: SAMPLE - len(rows)]
    rng.shuffle(rows)
    return rows


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


ROWS: list[tuple[np.ndarray, np.ndarray]] = []  # of the processes of one training


def gradient(job: tuple[dict[str, np.ndarray], np.ndarray, bool]) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients over the windows ``chunk`` of ROWS."""
    P, chunk, crf = job
    H, K = P["wh0"].shape[0], pii.TAGS
    x, y, n = padded([ROWS[i] for i in chunk])
    L, B = x.shape
    live = (np.arange(L)[:, None] < n[None, :]).astype(np.float32)
    loss = 0.0
    E = P["embed"][x]
    cache, hs = [], np.zeros((L, B, 2 * H), np.float32)
    for d in (0, 1):
        into = E @ P[f"wx{d}"] + P[f"b{d}"]
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        kept = [None] * L
        for t in range(L) if d == 0 else range(L - 1, -1, -1):
            z = into[t] + h @ P[f"wh{d}"]
            g = pii.gate(z[:, : 3 * H])
            u = pii.squash(z[:, 3 * H :])
            c2 = g[:, H : 2 * H] * c + g[:, :H] * u
            q = pii.squash(c2)
            h2 = g[:, 2 * H :] * q
            m = live[t][:, None]
            kept[t] = (z, g, u, c, c2, q, h)
            h, c = h2 * m, c2 * m
            hs[t, :, d * H : (d + 1) * H] = h
        cache.append(kept)
    S = hs @ P["out"] + P["out_bias"]
    if not crf:
        e = np.exp(S - S.max(axis=2, keepdims=True))
        e /= e.sum(axis=2, keepdims=True)
        gold = np.zeros_like(e)
        np.put_along_axis(gold, y[:, :, None], 1, 2)
        loss -= float((np.log((e * gold).sum(axis=2) + 1e-9) * live).sum())
        dS = ((e - gold) * live[:, :, None] / B).astype(np.float32)
        G = {"out": hs.reshape(L * B, -1).T @ dS.reshape(L * B, -1), "out_bias": dS.sum(axis=(0, 1))}
    else:
        # CRF: forward and backward sums
        alpha, beta = np.zeros((L, B, K)), np.zeros((L, B, K))
        alpha[0] = S[0] + P["first"]
        for t in range(1, L):
            a = logsumexp(alpha[t - 1][:, :, None] + P["trans"][None], 1) + S[t]
            alpha[t] = np.where(live[t][:, None] > 0, a, alpha[t - 1])
        logz = logsumexp(alpha[-1], 1)
        for t in range(L - 2, -1, -1):
            b = logsumexp(P["trans"][None] + (S[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[t + 1][:, None] > 0, b, 0)
        marg = np.exp(alpha + beta - logz[None, :, None]) * live[:, :, None]
        gold = np.zeros_like(marg)
        np.put_along_axis(gold, y[:, :, None], 1, 2)
        gold *= live[:, :, None]
        score = (S * gold).sum() + P["first"][y[0]].sum()
        both = live[1:] > 0
        score += P["trans"][y[:-1], y[1:]][both].sum()
        loss += float(logz.sum() - score)
        dS = ((marg - gold) / B).astype(np.float32)
        pair = np.zeros((K, K))
        for t in range(1, L):
            w = np.exp(alpha[t - 1][:, :, None] + P["trans"][None] + (S[t] + beta[t])[:, None, :] - logz[:, None, None])
            pair += (w * live[t][:, None, None]).sum(axis=0)
        np.subtract.at(pair, (y[:-1][both], y[1:][both]), 1)
        G = {"trans": (pair / B).astype(np.float32), "first": dS[0].sum(axis=0), "out": hs.reshape(L * B, -1).T @ dS.reshape(L * B, -1), "out_bias": dS.sum(axis=(0, 1))}
    dh_all = dS @ P["out"].T
    dE = np.zeros_like(E)
    for d in (0, 1):
        dh, dc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        dZ = np.zeros((L, B, 4 * H), np.float32)
        dW = np.zeros_like(P[f"wh{d}"])
        for t in range(L - 1, -1, -1) if d == 0 else range(L):
            z, g, u, c, c2, q, h = cache[d][t]
            m = live[t][:, None]
            dh2 = (dh + dh_all[t, :, d * H : (d + 1) * H]) * m
            dc2 = dc * m + dh2 * g[:, 2 * H :] / (1 + np.abs(c2)) ** 2
            dg = np.concatenate([dc2 * u, dc2 * c, dh2 * q], axis=1)
            dz = np.concatenate([dg * np.where(np.abs(z[:, : 3 * H]) < 2, np.float32(0.25), np.float32(0.05)), dc2 * g[:, :H] / (1 + np.abs(z[:, 3 * H :])) ** 2], axis=1)
            dZ[t] = dz
            dW += h.T @ dz
            dh, dc = dz @ P[f"wh{d}"].T, dc2 * g[:, H : 2 * H]
        G[f"wh{d}"], G[f"b{d}"] = dW, dZ.sum(axis=(0, 1))
        G[f"wx{d}"] = E.reshape(L * B, -1).T @ dZ.reshape(L * B, -1)
        dE += dZ @ P[f"wx{d}"].T
    G["embed"] = np.zeros_like(P["embed"])
    np.add.at(G["embed"], x.reshape(-1), dE.reshape(-1, dE.shape[-1]))
    return loss, G


def train(rows: list, epochs: int, crf_epochs: int = 3, hidden: int = 24, dim: int = 20, seed: int = 5, begin: str = "") -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    H, K = hidden, pii.TAGS
    P = {"embed": rng.normal(0, 0.3, (pii.CLASSES, dim)), "out": rng.normal(0, 0.2, (2 * H, K)), "out_bias": np.zeros(K), "trans": np.zeros((K, K)), "first": np.zeros(K)}
    for d in (0, 1):
        P[f"wx{d}"] = rng.normal(0, 1 / np.sqrt(dim), (dim, 4 * H))
        P[f"wh{d}"] = rng.normal(0, 1 / np.sqrt(H), (H, 4 * H)) * 0.8
        P[f"b{d}"] = np.concatenate([np.zeros(H), np.ones(H), np.zeros(2 * H)])
    P = {k: v.astype(np.float32) for k, v in P.items()}
    if begin:  # goes on from earlier weights
        with np.load(begin) as f:
            P = {k: f[k].astype(np.float32) for k in P}
    for k in range(len(pii.TYPES)):  # an inside tag follows its own begin or inside tag only
        for j in range(K):
            if j not in (1 + 2 * k, 2 + 2 * k):
                P["trans"][j, 2 + 2 * k] = -20
    ROWS[:] = rows
    parts = os.cpu_count() or 1
    M, V, step = {k: np.zeros_like(v) for k, v in P.items()}, {k: np.zeros_like(v) for k, v in P.items()}, 0
    order = np.argsort([len(r[0]) for r in rows], kind="stable")
    pool = multiprocessing.get_context("fork").Pool(parts)
    for epoch in range(epochs):
        crf = epoch >= epochs - crf_epochs  # first each character's own tag is learnt, then whole paths
        size = 32 * parts
        chunks = [order[i : i + size] for i in range(0, len(order), size)]
        rng.shuffle(chunks)
        loss, norms = 0.0, []
        for chunk in chunks:
            done = pool.map(gradient, [(P, part, crf) for part in np.array_split(chunk, parts) if len(part)], chunksize=1)
            loss += sum(d[0] for d in done)
            G = {k: sum(d[1][k] for d in done) / len(done) for k in P if k in done[0][1]}
            norm = np.sqrt(sum(float((v**2).sum()) for v in G.values()))
            norms.append(norm)
            step += 1
            rate = 2e-3 * (epochs - epoch) / crf_epochs if crf else (4e-3 if begin else 1e-2) * (epochs - crf_epochs - epoch) / (epochs - crf_epochs)
            clip = np.float32(min(1, 2 / max(norm, 1e-9)))
            rate *= np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in G.items():
                M[k] = 0.9 * M[k] + 0.1 * v * clip
                V[k] = 0.999 * V[k] + 0.001 * (v * clip) ** 2
                P[k] = P[k] - (rate * M[k] / (np.sqrt(V[k]) + 1e-7)).astype(np.float32)
        print("epoch", epoch, "loss", round(loss / len(rows), 4), "median norm", round(float(np.median(norms)), 3), flush=True)
    pool.close()
    return P


def labelled(path: str) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    texts = [t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t and not SKIP.search(t)]
    return texts, [marks(t) for t in texts]


if __name__ == "__main__":
    source = random.Random(3)
    given, found = labelled(sys.argv[1])
    begun = sys.argv[3] if len(sys.argv) > 3 else ""
    data = examples(given, found, source, pii.Tagger(begun) if begun else None)
    held = len(data) // 10
    print(len(given), "texts", sum(map(len, found)), "spans", len(data), "windows", sum(len(r[0]) for r in data), "characters", flush=True)
    kept = data[held:]
    if begun:  # what the earlier weights get wrong counts three times
        kept += 2 * [kept[i] for i in np.flatnonzero(wrong_tags(pii.Tagger(begun), kept))]
    weights = train(kept, int(sys.argv[2]) if len(sys.argv) > 2 else 24, crf_epochs=int(sys.argv[4]) if len(sys.argv) > 4 else 3, begin=begun)
    np.savez_compressed(pii.WEIGHTS, **{k: v.astype(np.float16) for k, v in weights.items()})
    wrong = wrong_tags(pii.Tagger(pii.WEIGHTS), data[:held]).sum()
    print("held out: share of characters with the right tag", 1 - wrong / sum(len(r[0]) for r in data[:held]))
