"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, node string, " \
         "size string, rank string, bucket string, row string, copies string"


def vocabulary(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = ["an", "be", "co", "dé", "ge", "öl", "ra", "ti", "un", "vo", "zu", "ñe"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts(seed: int = 7) -> list[str | None]:
    r, words = random.Random(seed), vocabulary(400, seed)

    def prose(n: int) -> list[str]:
        return [r.choice(words) for _ in range(n)]

    shared = prose(70)
    base = prose(150)
    near = [base[:k] + [w + "x" for w in base[k:k + 2]] + base[k + 2:] for k in (10, 50, 90)]
    out: list[str | None] = [None, "", "   \n\t ", "one", "two words", "Four of these words"]
    out += [" ".join(base)] * 5 + [" ".join(x) for x in near] + [" ".join(base).upper()]
    out += [" ".join(prose(40) + shared + prose(30)) for _ in range(6)]
    out += [" ".join(shared * 3), "\n".join([" ".join(prose(12))] * 4), " ".join(["same"] * 90), "a" * 3000]
    out += [" ".join(prose(9000)), "## ** $$ %% && || << >> " * 20, "no-break space and　wide " * 12]
    out += ["<|endoftext|> in a text<|endoftext|>, don't and we'll 12345 x1y2 " * 3, "tail \n\n\n", " lead", "é" * 120]
    out += [" ".join(prose(r.randint(1, 120))) for _ in range(30)]
    return out


def rows(seed: int = 7) -> list[tuple]:
    found = texts(seed)
    out = [(3 * i, t, "en", (None, "hot", "hot", "rare", "mid")[i % 5], 0, *["clash"] * 8) for i, t in enumerate(found)]
    random.Random(1).shuffle(out)
    return out


def items() -> list[tuple]:
    found = [t for t in texts() if t]
    words = found[11].split()
    return [(1, " ".join(words[45:70])), (2, found[8]), (3, "Two, WORDS!"), (4, None), (5, "..."), (None, "one"),
            (7, " ".join(words[45:70])), (8, "never seen anywhere in any of these texts at all, is it")]
