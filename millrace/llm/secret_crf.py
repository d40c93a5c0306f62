"""Secret scan by fixed patterns and a linear-chain conditional random field.

Patterns find assignments, access keys and hex strings. A linear-chain CRF adds
spans: it tags tokens as secret begin, inside or outside from their shape,
their neighbouring words and features of the file, and is decoded by Viterbi.

Tokens of at least ``MIN_TOKEN`` characters may carry B or I if they hold a digit,
a capital after a small letter or ``MANY`` distinct characters, follow a cue word in
their line, or touch such a token; so may tokens of ``MIN_CUED`` characters that
hold a digit and follow a cue word. All other tokens are outside. The chain
runs over the admissible tokens of a line; I needs exactly one character to
the token before. Features see whole tokens and the three whole words before
them. The field is trained on generated lines by this module (run
``python -m millrace.llm.secret_crf`` to write ``secret_crf.json`` anew); scans
read the weights from that file.

Defined results: null text is empty and has no spans; offsets are code points;
spans that begin together are ordered as the kinds are listed; texts of any length
are scanned whole; repeated rows are scanned one by one; an empty table yields no
rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter, deque
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_TOKEN, MIN_CUED = 8, 6
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{6,}")
WEIGHTS = Path(__file__).with_name("secret_crf.json")
PLAIN = re.compile("[A-Za-z]?[a-z]+")
ODD = re.compile("[0-9]|[a-z][A-Z]")
MANY = 12  # fewer distinct characters have an entropy below 3.5 bits
CUE = re.compile(r"pass|secret|token|key|auth|bearer|cred|private|login|pwd", re.IGNORECASE)
FALSE_CUE = re.compile(r"phone|tel|call|date|isbn|order|id|version|mail|invoice|page|fax|price|card", re.IGNORECASE)
CODE = re.compile(r"[{};]\s*\n|\bimport\b|\bexport\b|=>")

STATES = ("O", "B", "I")
FEATURES = (
    "bias", "hex", "has_upper", "has_lower", "mixed", "digits_low", "digits_mid", "digits_all", "len_12", "len_16", "len_24", "len_32",
    "entropy_3", "entropy_35", "entropy_4", "changes", "dashes", "dots", "prefix", "at_sign", "cue_left", "false_cue_left", "assigned", "quoted",
    "glued", "no_digit", "inner_case", "plain", "cued_value", "cued_digit", "file_code", "file_cue", "file_many",
)
INNER = re.compile("[a-z](?=[A-Z])")
PREFIX = re.compile(r"(ghp|gho|sk|pk|xox[bpas]|eyJ|AKIA|AIza|glpat|hf|rk|ya29)[_A-Za-z0-9-]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns; failing matches use up their characters."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # maximal runs: those of 24 and more are just the long ones among all runs
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def admissible(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that may be part of a secret, in time linear in the text."""
    tokens, odd = [], []
    cues = [m.end() for m in CUE.finditer(text)]
    c = 0
    for m in TOKEN.finditer(text):
        token = m[0].rstrip(".-/")  # of the sentence, not of the token
        start = m.start()
        while c < len(cues) and cues[c] <= start:
            c += 1
        cued = c and start - cues[c - 1] <= 40 and "\n" not in text[cues[c - 1] : start]
        if len(token) < MIN_TOKEN and not (cued and len(token) >= MIN_CUED and any(x.isdigit() for x in token)):
            continue
        tokens.append((start, start + len(token)))
        odd.append(bool(cued or ODD.search(token) or len(set(token)) >= MANY))
    touch = [j > 0 and a - tokens[j - 1][1] == 1 and not text[a - 1].isspace() for j, (a, _) in enumerate(tokens)]
    for order in (range(1, len(tokens)), range(len(tokens) - 1, 0, -1)):
        for j in order:
            if touch[j] and odd[j] != odd[j - 1]:
                odd[j] = odd[j - 1] = True
    return [t for t, keep in zip(tokens, odd) if keep]


def file_features(text: str, n_tokens: int) -> tuple[float, float, float]:
    return float(bool(CODE.search(text))), float(any(k in text.lower() for k in KEYWORDS)), float(n_tokens * 200 > len(text))


WORD = re.compile(r"[^ \t\n]+|\n")


def contexts(text: str, tokens: list[tuple[int, int]], many: int = 3):
    """For each token where its last ``many`` words of the line before it begin, and whether they hold a cue, and a false cue.

    Words and cues are passed once, in step with the tokens, so that a line of any length costs its length.
    """
    words, cues, false_cues = WORD.finditer(text), CUE.finditer(text), FALSE_CUE.finditer(text)
    line, last, word = 0, deque(maxlen=many), next(words, None)
    cue, next_cue, false, next_false = -1, next(cues, None), -1, next(false_cues, None)
    for start, _ in tokens:
        while word and word.start() < start:
            if word[0] == "\n":
                line = word.end()
                last.clear()
            else:
                last.append(word.start())
            word = next(words, None)
        while next_cue and next_cue.end() <= start:
            cue, next_cue = next_cue.start(), next(cues, None)
        while next_false and next_false.end() <= start:
            false, next_false = next_false.start(), next(false_cues, None)
        at = last[0] if len(last) == many else line
        yield at, cue >= at, false >= at


def last_sign(text: str, at: int, start: int) -> str:
    """The last character from ``at`` on before ``start`` that is neither a blank nor a quote."""
    while start > at and text[start - 1] in " \"'`":
        start -= 1
    return text[start - 1 : start] if start > at else ""


def token_features(text: str, start: int, end: int, glued: bool, context: tuple[int, bool, bool], of_file: tuple[float, float, float]) -> list[float]:
    """Shape, neighbouring words and file features of one token, in the order of FEATURES."""
    token = text[start:end]
    n = len(token)
    seen = Counter(token)
    digits = sum(k for c, k in seen.items() if c.isdigit())
    upper, lower = any(c.isupper() for c in seen), any(c.islower() for c in seen)
    counts = np.array(list(seen.values())) / n
    entropy = float(-(counts * np.log2(counts)).sum())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    at, cue, false_cue = context
    left = text[max(at, start - 1) : start]
    assigned = last_sign(text, at, start) in (":", "=")
    flags = (
        True, all(c in "0123456789abcdefABCDEF-" for c in seen), upper, lower, upper and lower, digits / n < 0.15, 0.15 <= digits / n < 0.7, digits / n >= 0.9,
        n >= 12, n >= 16, n >= 24, n >= 32, entropy >= 3, entropy >= 3.5, entropy >= 4, changes >= 4, token.count("-") + token.count("/") >= 2, token.count(".") >= 2,
        bool(PREFIX.match(token)), left == "@" or text[end : end + 1] == "@", cue, false_cue, assigned, left in ("'", '"', "`"), glued,
        not digits, len(INNER.findall(token)) >= 3, bool(PLAIN.fullmatch(token)), cue and assigned, cue and digits > 0,
    )
    return [*map(float, flags), *of_file]


def runs_of(text: str) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """The admissible tokens of each line, with their features."""
    tokens = admissible(text)
    if not tokens:
        return []
    of_file, out = file_features(text, len(tokens)), []
    for k, ((start, end), context) in enumerate(zip(tokens, contexts(text, tokens))):
        glued = bool(k) and start - tokens[k - 1][1] == 1
        row = token_features(text, start, end, glued, context, of_file)
        if k and "\n" not in text[tokens[k - 1][1] : start]:
            out[-1][0].append((start, end))
            out[-1][1].append(row)
        else:
            out.append(([(start, end)], [row]))
    return [(spans, np.array(rows)) for spans, rows in out]


def emissions(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(tokens, states); a token that is not glued to the one before is not inside."""
    out = x @ w
    out[x[:, FEATURES.index("glued")] == 0, 2] -= 1e4
    return out


def viterbi(emission: np.ndarray, move: np.ndarray, begin: np.ndarray) -> list[int]:
    """The best path of states; emission is (tokens, states)."""
    best, back = begin + emission[0], []
    for e in emission[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(0))
        best = ways.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def log_likelihood(runs, w, move, begin):
    """Mean log-likelihood of labelled runs and its gradients, by forward and backward sums."""
    total, gw, gm, gb = 0.0, np.zeros_like(w), np.zeros_like(move), np.zeros_like(begin)
    lse = lambda a, axis: a.max(axis) + np.log(np.exp(a - np.expand_dims(a.max(axis), axis)).sum(axis))
    for x, y in runs:
        e, n = emissions(x, w), len(y)
        alpha, beta = np.empty((n, 3)), np.zeros((n, 3))
        alpha[0] = begin + e[0]
        for t in range(1, n):
            alpha[t] = lse(alpha[t - 1][:, None] + move, 0) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = lse(move + (e[t + 1] + beta[t + 1])[None, :], 1)
        z = lse(alpha[-1], 0)
        seen = np.eye(3)[y]
        total += begin[y[0]] + e[np.arange(n), y].sum() + sum(move[a, b] for a, b in zip(y, y[1:])) - z
        miss = seen - np.exp(alpha + beta - z)
        gw += x.T @ miss
        gb += miss[0]
        for t in range(1, n):
            gm[y[t - 1], y[t]] += 1
            gm -= np.exp(alpha[t - 1][:, None] + move + (e[t] + beta[t])[None, :] - z)
    return total / len(runs), gw / len(runs), gm / len(runs), gb / len(runs)


def training_lines(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the spans of their secrets; half of them hold none."""
    rng = np.random.default_rng(seed)
    alnum, hexes, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "0123456789"
    letters = alnum[:26], alnum[26:52]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    pick = lambda options: options[int(rng.integers(len(options)))]
    words = lambda: " ".join(draw("etaoinshrdlu", int(rng.integers(2, 9))) for _ in range(int(rng.integers(1, 7))))
    out = []
    for _ in range(n):
        lead, tail = words(), words()
        if rng.random() < 0.5:
            cue = pick(["password", "secret", "token", "api key", "auth", "Bearer", "private key", "credentials", "access_key", "pwd", ""])
            joint = pick([": ", "=", " = ", ' = "', ": '", " ", " is "])
            parts = [pick([pick(["ghp_", "sk-", "glpat-", "xoxb-", "AKIA", "", ""]) + draw(alnum, int(rng.integers(16, 44))) + draw(digits, 2), draw(hexes, int(rng.integers(20, 64))) + "7"])]
            if rng.random() < 0.3:  # a short word and digits
                cue = cue or "password"
                parts = [draw("etaoinshrdlu", int(rng.integers(4, 9))) + draw(digits, int(rng.integers(1, 4)))]
            if rng.random() < 0.4:  # without a digit
                cue = cue or "passphrase"
                mixed = lambda: "".join(draw(letters[i % 2], 1) for i in range(int(rng.integers(14, 30))))  # noqa: B023, E731
                phrase = lambda: "-".join(draw("etaoinshrdlu", int(rng.integers(4, 8))) for _ in range(4))
                camel = lambda: "".join(draw("abcdefghijklmnopqrstuvwxyz", int(rng.integers(2, 6))).capitalize() for _ in range(4))
                kind = pick([mixed, lambda: draw(letters[0] + letters[1], int(rng.integers(16, 40))), phrase, camel])
                joint = pick([": ", "=", " = ", ' = "', ": '"]) if kind in (phrase, camel) else joint
                parts = [kind()]
            if rng.random() < 0.3 and "-" not in parts[0]:
                parts.append(draw(alnum, int(rng.integers(10, 30))) + draw(digits, 2))
            head, secret = f"{lead} {cue}{joint}", pick([":", "$", "~"]).join(parts)
            out.append((f"{head}{secret} {tail}", [(len(head), len(head) + len(secret))]))
        else:
            other = pick(
                [
                    lambda: f"{pick(['phone', 'call', 'tel', 'fax', ''])} +{draw(digits, 2)}-{draw(digits, 3)}-{draw(digits, 3)}-{draw(digits, 4)}",
                    lambda: f"{pick(['on', 'date', 'since'])} 20{draw(digits, 2)}-{draw('01', 1)}{draw('12', 1)}-{draw('12', 1)}{draw(digits, 1)}",
                    lambda: f"{pick(['id', 'order', 'invoice', 'card', 'ISBN', ''])} {draw(digits, int(rng.integers(8, 17)))}",
                    lambda: f"+{draw(digits, 1)} ({draw(digits, 3)}) {draw(digits, 3)}-{draw(digits, 4)}",
                    lambda: draw(digits, int(rng.integers(12, 20))),
                    lambda: f"{draw(digits, 2)}.{draw(digits, 2)}.{draw(digits, 3)}.{draw(digits, 3)}",
                    lambda: f"{pick(['version', 'release', 'build'])} {draw(digits, 2)}.{draw(digits, 2)}.{draw(digits, 3)}",
                    lambda: f"{pick(['mail', 'write', ''])} {draw('etaoinsr', 7)}.{draw(digits, 2)}@mail{draw(digits, 1)}.example.com",
                    lambda: f"{draw(digits, 3)}.{draw(digits, 3)}.{draw(digits, 2)}.{draw(digits, 2)}",
                    lambda: f"{draw('etaoinsr', 6)}/{draw('etaoinsr', 6)}/page_{draw(digits, 3)}.html",
                    lambda: f"{pick(['the secret', 'a token', 'key', 'password', 'login', 'author', ''])} {draw('etaoinshrdlu', int(rng.integers(8, 16)))}",
                    lambda: f"{pick(['author', 'password', 'key', 'note'])}: {draw('etaoinshrdlu', int(rng.integers(8, 15)))} {words()}",
                    lambda: "-".join(draw("etaoinshrdlu", int(rng.integers(2, 8))) for _ in range(int(rng.integers(2, 5)))),
                    lambda: draw("etaoinshrdlu", 5) + "".join(draw("etaoinshrdlu", int(rng.integers(3, 8))).capitalize() for _ in range(int(rng.integers(1, 4)))),
                    lambda: draw("abcdefghijklmnopqrstuvwxyz", int(rng.integers(12, 24))).capitalize(),
                    lambda: f"{draw('etaoinsr', int(rng.integers(6, 14)))}{draw(digits, int(rng.integers(1, 4)))}",
                ]
            )()
            out.append((f"{lead} {other} {tail}", []))
        if len(out) > 1 and rng.random() < 0.25:  # two on a line
            (a, of_a), (b, of_b) = out.pop(), out.pop()
            out.append((f"{a}, {b}", of_a + [(x + len(a) + 2, y + len(a) + 2) for x, y in of_b]))
    return out


def labelled_runs(lines):
    out = []
    for text, secrets in lines:
        for spans, x in runs_of(text):
            y = []
            for start, end in spans:
                inside = next(((a, b) for a, b in secrets if a <= start and end <= b), None)
                y.append(0 if inside is None else 2 if start > inside[0] else 1)
            out.append((x, np.array(y)))
    return out


@lru_cache(maxsize=1)
def trained(n_lines: int = 2000, seed: int = 11, steps: int = 150, l2: float = 1e-3):
    """(w, move, begin), by Adam on the regularised log-likelihood; I never follows O."""
    runs = labelled_runs(training_lines(n_lines, seed))
    theta = [np.zeros((len(FEATURES), 3)), np.zeros((3, 3)), np.zeros(3)]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    never = np.zeros((3, 3)), np.zeros(3)
    never[0][0, 2] = never[1][2] = -1e4
    for k in range(1, steps + 1):
        _, *grads = log_likelihood(runs, theta[0], theta[1] + never[0], theta[2] + never[1])
        for i, g in enumerate(grads):
            g = g - l2 * theta[i]
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.999 * m2[i] + 0.001 * g * g
            theta[i] = theta[i] + 0.1 * (m1[i] / (1 - 0.9**k)) / (np.sqrt(m2[i] / (1 - 0.999**k)) + 1e-8)
    return theta[0], theta[1] + never[0], theta[2] + never[1]


@lru_cache(maxsize=1)
def shipped():
    """(w, move, begin) as ``trained`` found them."""
    return tuple(np.array(x) for x in json.loads(WEIGHTS.read_text()))


def crf_spans(text: str, model) -> list[tuple[str, int, int]]:
    """Spans from each B to the last I after it."""
    w, move, begin = model
    out = []
    for spans, x in runs_of(text):
        for (start, end), state in zip(spans, viterbi(emissions(x, w), move, begin)):
            if state == 1:
                out.append(("crf", start, end))
            elif state == 2:
                out[-1] = ("crf", out[-1][1], end)
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets array<struct<kind, start, end>>) of each row, in order of start and kind."""
    model = shipped()

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = sorted(base_spans(text) + crf_spans(text, model), key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "secrets"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, secrets array<struct<kind: string, start: long, end: long>>")


def span_digest(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


if __name__ == "__main__":
    WEIGHTS.write_text(json.dumps([np.round(x, 6).tolist() for x in trained()]))
