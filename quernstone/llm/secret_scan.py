"""Secret scans: base rules, and a character network over every candidate with its surrounding context.

The base rules give spans that always stay. Beside them every run of key-like characters that could be a secret is
a candidate: its characters with those before and after are read by a convolutional network in NumPy, whose
calibrated probability must reach the threshold of the candidate's family. Thresholds are the highest that
keep a stated recall on labelled findings that the network was not trained on.

The fit reads all findings of all documents. They are dealt by hash to shards of a bounded size; in each round every
shard makes one pass of Adam from the same parameters, and the next round starts from the mean over all shards.

Labelled findings come from four places, or from the caller: what the base rules find in the corpus (secret), the
candidates of the corpus that they do not find (none), secrets generated in published token formats, and
generated look-alikes such as UUIDs, dates, file names and account numbers, both in contexts of the corpus.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import written
from quernstone.operators.metrics import running_totals
from quernstone.scratch import discard

#: Fixed values of the base rules, in the order in which kinds are listed: name, pattern, the group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

#: A candidate: a run of key-like characters with a digit, or a value after a word that announces one.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
CUED = re.compile(r"""(?:pwd|pass(?:phrase|word|wd)?|auth(?:orization)?|bearer|credentials?|secret|token|[a-z_-]{0,24}key)["']?(?:\x20*[:=]\x20*|\x20)["']?((?=[^\s"']*[0-9])[^\s"',;]{6,})""", re.IGNORECASE | re.ASCII)
CUED_WORDS = ("pwd", "pass", "auth", "bearer", "credential", "secret", "token", "key")
DIGIT = re.compile(r"[0-9]")
FAMILIES = ("hex", "cued", "run")

#: Characters before, inside (the first and the last ones of a longer candidate) and after.
BEFORE, HEAD, TAIL, AFTER = 24, 40, 24, 8
INSIDE = HEAD + TAIL
WIDTH = BEFORE + INSIDE + AFTER
SYMBOLS, EMBEDDED, FILTERS, SPAN = 99, 12, 32, 5
PLACES = WIDTH - SPAN + 1
REGIONS = (slice(0, BEFORE - SPAN + 1), slice(BEFORE - 2, BEFORE + INSIDE - 2), slice(BEFORE + INSIDE - 2, PLACES))

#: A shard has two to four times as many findings, and as many again of generated secrets and of look-alikes as twice this.
SHARD_FINDINGS = 2_000
#: Passes over all findings, the rows of a step, and the most sums of shards that reach the driver in a round.
EPOCHS, BATCH, SUMS = 10, 128, 32
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base rules, by start and then kind as listed; code points, end exclusive."""
    out = []
    lower = text.lower()
    if any(c in lower for c in CUES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, family) of what may be a secret, by start, without overlaps; announced values first."""
    lower, out = text.lower(), []
    if any(c in lower for c in CUED_WORDS):
        out = [(m.start(1), m.end(1), "cued") for m in CUED.finditer(text)]
    taken = iter(out)
    cued, runs = next(taken, None), []
    for m in RUN.finditer(text):
        s, e = m.span()
        if not DIGIT.search(text, s, e):
            continue
        while cued and cued[1] <= s:
            cued = next(taken, None)
        if not (cued and cued[0] < e):
            runs.append((s, e, "hex" if HEX.fullmatch(text, s, e) else "run"))
    return sorted(out + runs)


def apart(spans: list[tuple[int, int, str]], from_: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``spans`` that overlap none of ``from_``; both by start."""
    out, at, reach = [], 0, -1
    for s in spans:
        while at < len(from_) and from_[at][0] < s[1]:
            reach = max(reach, from_[at][1])
            at += 1
        if reach <= s[0]:
            out.append(s)
    return out


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    value = text[start:end] if end - start <= INSIDE else text[start : start + HEAD] + text[end - TAIL : end]
    return text[max(0, start - BEFORE) : start], value, text[end : end + AFTER]


def encode(windows: list[tuple[str, str, str]]) -> np.ndarray:
    """Symbols of windows by place: 0 where there is no character; a part has symbols of its own."""
    text = "".join(b.rjust(BEFORE, "\0") + v.ljust(INSIDE, "\0") + a.ljust(AFTER, "\0") for b, v, a in windows)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    symbol = np.where((code >= 32) & (code < 127), code - 31, np.where(code == 0, 0, np.where(code < 32, 96, np.where(code < 0x2000, 97, 98)))).reshape(-1, WIDTH)
    part = np.repeat([0, 1, 2], [BEFORE, INSIDE, AFTER]) * SYMBOLS
    return symbol + part


@dataclass
class Network:
    """Embedding, one convolution, maxima over the three parts and a mean over the candidate, then one logistic unit.

    ``slope`` and ``offset`` calibrate its output; ``thresholds`` has the least probability of each family.
    """

    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    constant: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] | None = None

    @classmethod
    def drawn(cls, seed: int) -> Network:
        rng, f = np.random.default_rng(seed), np.float32
        return cls(rng.normal(0, 0.5, (3 * SYMBOLS, EMBEDDED)).astype(f), rng.normal(0, (SPAN * EMBEDDED) ** -0.5, (SPAN * EMBEDDED, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, 4 * FILTERS).astype(f))

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        """The network whose arrays are views of ``flat``."""
        table, kernel, bias, weights, constant = np.split(flat, np.cumsum([3 * SYMBOLS * EMBEDDED, SPAN * EMBEDDED * FILTERS, FILTERS, 4 * FILTERS]))
        return cls(table.reshape(-1, EMBEDDED), kernel.reshape(-1, FILTERS), bias, weights, float(constant[0]))

    def flat(self) -> np.ndarray:
        """All parameters as one vector."""
        return np.concatenate([self.table.ravel(), self.kernel.ravel(), self.bias, self.weights, [self.constant]]).astype(np.float32)

    @staticmethod
    def pooled(hidden: np.ndarray) -> np.ndarray:
        return np.concatenate([*[hidden[:, r].max(1) for r in REGIONS], hidden[:, REGIONS[1]].mean(1)], 1)

    def margins(self, symbols: np.ndarray, rows: int = 512) -> np.ndarray:
        """Raw outputs; embedding and kernel are folded into one table for each place of the kernel.

        An output depends on its own row alone, to the last bit: equal windows pass a threshold together in any batch.
        """
        taps = [self.table @ self.kernel[o * EMBEDDED : (o + 1) * EMBEDDED] for o in range(SPAN)]
        out = np.empty(len(symbols), np.float64)
        for at in range(0, len(symbols), rows):
            ids = symbols[at : at + rows]
            hidden = taps[0][ids[:, :PLACES]]
            for o in range(1, SPAN):
                hidden += taps[o][ids[:, o : o + PLACES]]
            out[at : at + rows] = (self.pooled(np.maximum(hidden + self.bias, 0)) * self.weights).sum(1) + self.constant
        return out

    def calibrated(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))

    def probabilities(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        return self.calibrated(self.margins(encode(windows))) if windows else np.zeros(0)

    def _gradients(self, ids, y, weight):
        n = len(ids)
        x = self.table[ids]
        columns = np.concatenate([x[:, o : o + PLACES] for o in range(SPAN)], 2)
        hidden = np.maximum(columns @ self.kernel + self.bias, 0)
        features = self.pooled(hidden)
        p = 1 / (1 + np.exp(-np.clip(features @ self.weights + self.constant, -35, 35)))
        d = (weight * (p - y) / n).astype(np.float32)
        to_features, to_hidden = d[:, None] * self.weights, np.zeros_like(hidden)
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)
        for k, r in enumerate(REGIONS):
            to_hidden[rows, hidden[:, r].argmax(1) + r.start, filters] += to_features[:, k * FILTERS : (k + 1) * FILTERS]
        to_hidden[:, REGIONS[1]] += to_features[:, None, 3 * FILTERS :] / (REGIONS[1].stop - REGIONS[1].start)
        to_hidden *= hidden > 0
        to_columns, to_x = to_hidden @ self.kernel.T, np.zeros_like(x)
        for o in range(SPAN):
            to_x[:, o : o + PLACES] += to_columns[:, :, o * EMBEDDED : (o + 1) * EMBEDDED]
        to_table = np.zeros_like(self.table)
        np.add.at(to_table, ids, to_x)
        kernel = columns.reshape(-1, SPAN * EMBEDDED).T @ to_hidden.reshape(-1, FILTERS)
        return to_table, kernel, to_hidden.sum((0, 1)), features.T @ d, np.array([d.sum()], np.float32)

    def calibrate(self, margins: DataFrame, recall: float) -> None:
        """Logistic slope and offset by Newton steps, then the highest threshold of each family that keeps ``recall``.

        ``margins`` is a written table (family, label, margin); only sums and single values of it reach the driver. A
        threshold is the score of the secret with rank floor((1 - recall) * (n + 1)) from below, which keeps
        the recall on new secrets of the same origin in expectation; families with under 30 secrets share one over all.
        """
        counts = {tuple(r)[:2]: r[2] for r in margins.groupBy("family", "label").count().collect()}
        ones, zeros = (sum(n for (_, y), n in counts.items() if y == label) for label in (1, 0))
        target = F.when(F.col("label") > 0, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))
        x, beta = F.col("margin"), np.array([1.0, 0.0])
        for _ in range(30):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.lit(float(beta[0])) * x + F.lit(float(beta[1]))))))
            row = margins.select(x, (p * (1 - p)).alias("w"), (p - target).alias("d")).agg(F.sum(F.col("w") * x * x), F.sum(F.col("w") * x), F.sum("w"), F.sum(F.col("d") * x), F.sum("d")).first()
            xx, xc, cc, dx, dc = (float(v or 0) for v in row)
            step = np.linalg.solve(np.array([[xx, xc], [xc, cc]]) + 1e-3 * np.eye(2), np.array([dx, dc]) + 1e-3 * (beta - [1.0, 0.0]))
            beta -= step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = max(float(beta[0]), 1e-3), float(beta[1])

        secrets = margins.where("label = 1").select("family", "margin")
        values = written(secrets.union(secrets.select(F.lit("all"), "margin")).groupBy("family", "margin").agg(F.count(F.lit(1)).alias("n")), "values")
        totals = {f: counts.get((f, 1), 0) for f in FAMILIES} | {"all": ones}
        rank = F.create_map(*[F.lit(v) for f, n in totals.items() for v in (f, max(0, int((1 - recall) * (n + 1)) - 1))])
        upto = F.col("all_n") - F.col("cum_n") + F.col("n")  # secrets with this margin or a smaller one
        least = running_totals(values, "margin", ["n"], ["family"], totals=True).where(upto > rank[F.col("family")]).groupBy("family").agg(F.min("margin"))
        at = {f: float(self.calibrated(np.array([m]))[0]) for f, m in least.collect()}
        self.thresholds = {f: at[f] if totals[f] >= 30 else at.get("all", 1.0) for f in FAMILIES}
        discard(values)


def one_pass(state: np.ndarray, symbols: np.ndarray, labels: np.ndarray, turn: int, seed, batch: int = BATCH, rate: float = 0.004, decay: float = 1e-4) -> np.ndarray:
    """``state`` (parameters and their first and second moments, a row each) after one pass of Adam on the logistic loss, classes weighed equally."""
    flat, first, second = state = state.copy()
    net, parts = Network.of(flat), max(1, len(labels) // batch)
    share = min(max(labels.mean(), 0.05), 0.95)
    for step, chosen in enumerate(np.array_split(np.random.default_rng(seed).permutation(len(labels)), parts), turn * parts + 1):
        y = labels[chosen]
        net.constant = float(flat[-1])
        grads = net._gradients(symbols[chosen], y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))
        g = np.concatenate([x.ravel() for x in grads]) + decay * flat
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        flat -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return state


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = LOWER.upper() + LOWER + DIGITS


def generated(seed: int, each: int, contexts: list[tuple[str, str]]) -> Iterator[tuple[str, str, int]]:
    """(text, value, label): ``each`` secrets and look-alikes inside contexts (before, after)."""
    rng = random.Random(seed)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    name = lambda: word(LOWER, rng.randint(3, 9))
    url_safe = LETTERS + "-_"
    # fixed values: the public formats of access tokens
    secrets = [
        lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + word(LETTERS, 36), lambda: f"xoxb-{word(DIGITS, 11)}-{word(DIGITS, 12)}-{word(LETTERS, 24)}", lambda: "AIza" + word(url_safe, 35),
        lambda: rng.choice(["sk_live_", "rk_live_"]) + word(LETTERS, 24), lambda: "eyJ" + word(url_safe, 30) + ".eyJ" + word(url_safe, 60) + "." + word(url_safe, 43), lambda: word(LETTERS + "+/", 40),
        lambda: "npm_" + word(LETTERS, 36), lambda: "SG." + word(url_safe, 22) + "." + word(url_safe, 43), lambda: "glpat-" + word(url_safe, 20), lambda: word(LETTERS, rng.choice([24, 32, 48])), lambda: word(LETTERS + "+/", 86) + "==",
    ]
    cues = ["pwd", "passphrase", "auth", "access_key", "client_key", "private_key", "credentials", "Authorization: Bearer", "bearer", "secret_key", "signing-key"]
    date = lambda: f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    alike = [
        lambda: "-".join(word("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"{date()}T{rng.randint(0, 23):02}", lambda: f"{name()}_{date()}_v{rng.randint(1, 9)}.{rng.choice(['pdf', 'csv', 'png', 'tar.gz'])}",
        lambda: f"//{name()}.com/{name()}/{name()}-{rng.randint(1, 9999)}", lambda: f"{name()}.{word(DIGITS, 2)}", lambda: rng.choice(["DE", "FR", "ES", "GB"]) + word(DIGITS, 20), lambda: word(DIGITS, rng.choice([12, 13, 16])),
        lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{name()}.{rng.randint(1, 9)}", lambda: f"{name()}_{name()}_{rng.randint(1, 99999)}", lambda: f"{name()}/{name()}/{name()}{rng.randint(1, 99)}.py",
        lambda: f"10.{rng.randint(1000, 9999)}/{name()}.{rng.randint(1900, 2029)}.{rng.randint(1, 999)}", lambda: f"{word(DIGITS, 3)}-{word(DIGITS, 3)}-{word(DIGITS, 4)}", lambda: f"{name().title()}{name().title()}{rng.randint(1, 999)}", lambda: "=" * rng.randint(8, 30) + word(DIGITS, 4),
        lambda: f"{rng.randint(1, 300)}.{word(DIGITS, 9)}", lambda: f"{name()}.{name()}{rng.randint(1, 99)}",
    ]

    def anything() -> str:
        """Some words, numbers and marks, or nothing."""
        return "".join(rng.choice([name(), name().title(), word(DIGITS, rng.randint(1, 4)), word(LETTERS, rng.randint(1, 6))]) + rng.choice([" ", " ", " ", ", ", ". ", ": ", "\n", " (", "/", "; "]) for _ in range(rng.randint(0, 4)))

    def context() -> tuple[str, str]:
        if contexts and rng.random() < 0.5:
            return rng.choice(contexts)
        return anything(), rng.choice([" ", "", "\n", ", ", ". ", ") "]) + anything()

    for k in range(each):
        before, after = context()
        value = secrets[k % len(secrets)]()
        if rng.random() < 0.5:
            cue, quote = rng.choice(cues), rng.choice(["", '"', "'"])
            if rng.random() < 0.3:
                value = "".join(rng.sample(LETTERS, rng.randint(10, 20))) + rng.choice(DIGITS)
            before, after = before + cue + (" " if cue[-6:].lower() == "bearer" else rng.choice(["=", ": ", " = ", ":"])) + quote, quote + after
        elif before and before[-1] not in " \n\t\"'(":
            before += " "
        yield before + value + (after if after[:1] in ("", *" \n\t\"'),.;") else " " + after), value, 1
        before, after = context()
        if rng.random() < 0.3:
            before += rng.choice(["id=", "ref: ", "see ", "file ", "version ", "at "])
        elif before and before[-1] not in " \n\t\"'(":
            before += " "
        value = alike[k % len(alike)]()
        yield before + value + " " + after, value, 0


def labelled(texts: Iterator[tuple[str, str, int]]) -> list[tuple[str, str, str, str, int]]:
    """(before, value, after, family, label) of generated texts, as the scan would see them."""
    out = []
    for text, value, label in texts:
        at = text.index(value)
        for s, e, family in candidates(text):
            if s < at + len(value) and e > at:
                out.append((*window(text, s, e), family, label))
    return out


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """before, value, after, family, label of each base finding (1) and each candidate apart from them (0)."""

    def look(batches):
        for b in batches:
            rows = []
            for t in b["t"]:
                base = base_spans(t)
                # a rule's finding is what the network would see of it: the candidates that it covers
                seen = candidates(t)
                clean = {c[:2] for c in apart(seen, base)}
                rows += [(*window(t, s, e), family, int((s, e) not in clean)) for s, e, family in seen]
            yield pd.DataFrame(rows, columns=["before", "value", "after", "family", "label"])

    return docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(look, "before string, value string, after string, family string, label int")


def deal(found: DataFrame, each: int, shards: int, seed: int) -> DataFrame:
    """A row for each shard: encoded findings, ``each`` generated secrets and look-alikes among them, those to train with and those kept.

    A third of all, by hash of the value, is kept for calibration. What a shard generates has contexts of its own findings.
    """
    columns, names = ["before", "value", "after", "family", "label"], ["symbols", "labels", "kept_symbols", "kept_labels", "kept_families"]
    found = found.select(F.pmod(F.xxhash64("before", "value", "after"), F.lit(shards)).cast("int").alias("shard"), *columns)
    every = found.unionByName(found.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")), allowMissingColumns=True)  # no shard is missing

    def encoded(key, rows):
        rows = rows[rows["value"].notna()].sort_values(columns)
        real = list(zip(*(rows[c] for c in columns[:4]), rows["label"].astype(int), strict=True))
        of = real + labelled(generated(seed + int(key[0]), each, [(r[0], r[2]) for r in real if r[4] == 0]))
        kept = np.array([sum(r[1].encode()) % 3 == 0 for r in of])
        symbols, y = encode([r[:3] for r in of]).astype(np.uint16), np.array([r[4] for r in of], np.uint8)
        family = np.array([FAMILIES.index(r[3]) if r[3] in FAMILIES else len(FAMILIES) for r in of], np.uint8)
        cells = [symbols[~kept], y[~kept], symbols[kept], y[kept], family[kept]]
        return pd.DataFrame([[key[0], *[c.tobytes() for c in cells]]], columns=["shard", *names])

    return every.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(encoded, f"shard int, {', '.join(f'{n} binary' for n in names)}")


def train(dealt: DataFrame, net: Network, epochs: int, seed: int) -> Network:
    """``net`` after ``epochs`` rounds: each shard of ``dealt`` makes a pass, and the states are averaged by their rows.

    States are summed in the order of their shards, so the result does not depend on how shards meet in tasks;
    at most SUMS sums come to the driver in a round.
    """
    state = np.stack([net.flat(), *np.zeros((2, len(net.flat())), np.float32)])
    form = "shard int, rows long, state binary"

    def passes(now: np.ndarray, turn: int):
        def run(batches):
            for b in batches:
                for shard, symbols, labels in zip(b["shard"], b["symbols"], b["labels"], strict=True):
                    if labels:
                        y = np.frombuffer(labels, np.uint8).astype(np.float32)
                        new = one_pass(now, np.frombuffer(symbols, np.uint16).reshape(-1, WIDTH).astype(np.int32), y, turn, [seed, turn, shard])
                        yield pd.DataFrame({"shard": [shard], "rows": [len(y)], "state": [(len(y) * new.astype(np.float64)).tobytes()]})

        return run

    def total(key, rows):
        states = rows.sort_values("shard")["state"]
        out = np.frombuffer(states.iloc[0], np.float64).copy()
        for s in states.iloc[1:]:
            out += np.frombuffer(s, np.float64)
        return pd.DataFrame({"shard": [key[0]], "rows": [rows["rows"].sum()], "state": [out.tobytes()]})

    for turn in range(epochs):
        states = dealt.select("shard", "symbols", "labels").mapInPandas(passes(state, turn), form)
        sums = states.groupBy(F.pmod("shard", F.lit(SUMS)).alias("part")).applyInPandas(total, form).collect()
        if sums:
            new = sum(np.frombuffer(r["state"], np.float64) for r in sorted(sums, key=lambda r: r["shard"]))
            state = (new / sum(r["rows"] for r in sums)).reshape(state.shape).astype(np.float32)
    return Network.of(state[0].copy())


def kept_margins(dealt: DataFrame, net: Network) -> DataFrame:
    """family, label, margin of every finding that is kept for calibration; a family of a caller's own is other."""

    def run(batches):
        for b in batches:
            for symbols, labels, families in zip(b["kept_symbols"], b["kept_labels"], b["kept_families"], strict=True):
                if labels:
                    margins = net.margins(np.frombuffer(symbols, np.uint16).reshape(-1, WIDTH))
                    yield pd.DataFrame({"family": np.array([*FAMILIES, "other"])[np.frombuffer(families, np.uint8)], "label": np.frombuffer(labels, np.uint8).astype(np.int32), "margin": margins})

    return dealt.select("kept_symbols", "kept_labels", "kept_families").mapInPandas(run, "family string, label int, margin double")


def fit(docs: DataFrame, text: str = "text", found: DataFrame | None = None, recall: float = RECALL, sample_findings: int = SHARD_FINDINGS, seed: int = 11) -> Network:
    """Train the network, calibrate it and set thresholds of at least ``recall`` on findings kept apart.

    Reads every document and takes all distinct findings; ``found`` (before, value, after, family, label) replaces
    these by findings that were reviewed. They are dealt to shards of 2 to 4 times ``sample_findings``, one if they are fewer, and
    each shard generates twice ``sample_findings`` secrets and as many look-alikes beside them, so what a task holds is
    bounded and the work grows with the findings. A third of all, by hash of the value, is kept for calibration. Null
    texts are left out; an empty table leaves the generated findings alone.
    """
    found = findings(docs, text) if found is None else found
    found = written(found.select("before", "value", "after", "family", "label").distinct(), "findings")
    dealt = written(deal(found, 2 * sample_findings, max(1, found.count() // (2 * sample_findings)), seed), "dealt")
    net = train(dealt, Network.drawn(seed), EPOCHS, seed)
    margins = written(kept_margins(dealt, net), "margins")
    net.calibrate(margins, recall)
    for table in (found, dealt, margins):
        discard(table)
    return net


def scan_text(text: str, net: Network) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of all spans; those of base rules have probability 1."""
    base = base_spans(text)
    more = apart(candidates(text), base)
    scores = net.probabilities([window(text, s, e) for s, e, _ in more])
    added = [(s, e, "model", float(p)) for (s, e, family), p in zip(more, scores, strict=True) if p >= net.thresholds[family]]
    return sorted([(*b, 1.0) for b in base] + added, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``found``, an array of (kind, start, end, probability) by start, of every whole text; no shuffle.

    Positions are code points, end exclusive. Null and empty texts have none. Repeated rows give repeated
    results, an empty table an empty one; ids, null ones included, do not pass through Python, and other
    columns are not read. A base rule's span is its whole match; spans of kind ``model`` overlap none of them.
    A very long text needs memory in proportion to itself and its candidates.
    """
    shape = "array<struct<kind:string,start:int,end:int,probability:double>>"

    @F.pandas_udf(shape)
    def spans(column: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e, "probability": p} for s, e, k, p in scan_text(t, net)] if t else [] for t in column], dtype=object)

    return docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text)).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by base rule, the digest of the base spans, and all spans as text."""
    found = F.col("found")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter(found, lambda s: s["kind"] != "model"))
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), listed(found).alias("spans"), count("model"))
