"""Small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

NAMES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")
SCHEMAS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()),
                  ("source", pa.string()), ("n_chars", pa.int64())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                      ("text", pa.string())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
}
#: Names that operators use inside.
CLASHING = ("uid", "text_", "block", "words", "node", "total", "n_words", "kept", "digest", "rule")


def write(folder, rows: dict[str, list[tuple]], extra=()):
    for name in NAMES:
        schema = pa.schema(SCHEMAS[name])
        columns = list(zip(*rows.get(name, []), strict=True)) or [[] for _ in schema]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        for column in extra:
            table = table.append_column(column, pa.array([f"x{i}" for i in range(len(table))]))
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(n)]


def odd_rows() -> dict[str, list[tuple]]:
    rng = random.Random(3)
    shared, item = words(rng, 60), words(rng, 25)
    base = words(rng, 300)
    near = [*base[:100], "other", "words", *base[102:]]
    far = [w if i % 9 else "x" + w for i, w in enumerate(base)]
    texts = [
        None, "", "  \n\t ", "one", "One", "a b c d", "A  b\tc\nd", "a b c d e",
        " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far),
        " ".join([*words(rng, 40), *shared, *words(rng, 40)]),
        "\n".join([*words(rng, 7), *shared, *words(rng, 3)]),
        " ".join(shared[:35]), " ".join(shared[:34]), " ".join(shared * 3),
        " ".join([*words(rng, 20), *item[3:17], *words(rng, 5)]),
        " ".join([*words(rng, 20), *item, *item, "Ab-cD ef"]), "xx ab cd ef",
        "same line\nsame line\n\n \nother # $ line\nsame line", "la la la la la la " * 20,
        "é<|endoftext|> it's  two\u00a0spaces \u3000wide", "</s>[INST] ok [/INST]",
        " ".join(words(rng, 30_000)),
    ]
    documents = [
        (i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)
    ]
    documents += [documents[13], documents[13], documents[4]]
    documents += [(None, texts[8], "en", None, None), (None, "alone here", None, "s1", 3), (None, None, None, None, None)]
    html = "<p>" + " ".join(words(rng, 50)) + "</p>"
    pages = [
        (5, "http://A.example.net/en/x?y#z", html), (3, "https://example.net/en", html),
        (3, "https://example.net/en", html), (None, "ftp://x.org/fr/", html), (9, None, None),
        (10, "no scheme", ""), (11, "http://www.example.com/de/?q", "short"),
        (12, "http://net", "short"), (13, "://net/a", html + "!"), (14, "http://badexample.net/en/", None),
        (15, "http://Example.NET#/en/", "x" * 100), (16, "http://q.org/fr/a\nb", "x" * 100),
    ]
    benchmark = [
        (1, " ".join(item)), (2, "Ab cd EF!"), (3, None), (4, ""), (5, " ".join(item)),
        (None, "one"), (7, "-- ,,"), (20, " ".join(base[5:15])),
    ]
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None),
        (1, 2, "user", "tie"), (1, 2, "assistant", ""), (2, None, "sys]tem%5D", "<\\s>[ROLE:user] a [/ROLE]"),
        (2, 0, None, "a [/INST]<s> b </s>"), (None, 0, "assistant", "line\nline </s>"),
        (None, 0, "assistant", "line\nline </s>"), (3, 0, "user", "[/INST"), (3, 1, "assistant", " [/INST] "),
        (4, 0, "assistant", "<"), (4, 1, "assistant", "/s> <s"), (5, 0, "user", " " * 50 + "\\</s>" * 500),
    ]
    labels = [(i, i % 2, 1 if t and "shared" in t else 0) for i, t in enumerate(texts)]
    return {"documents": documents, "pages": pages, "benchmark": benchmark,
            "conversations": turns, "labels": labels + [(None, 1, 1), (2, None, None)]}


def plain(rows) -> list[str]:
    return sorted(repr(tuple(r)) for r in rows)


def duck(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()
