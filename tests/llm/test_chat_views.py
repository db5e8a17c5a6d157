import hashlib

from notelake.llm import chat_views as c

SCHEMA = "conv_id long, turn long, role string, text string, part string, speaker string"
TURNS = [
    (1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|end|> there"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 4, "c|d e", "Yes"),
    (2, 0, "user", "q"), (2, 0, "assistant", "tie"), (3, 0, "system", "alone"), (4, None, None, "x"), (4, 1, " ", "y"), (None, 0, "user", "null conversation"),
    (5, 0, "system", "for every part"), *((6, 3, "user", f"same turn {i:04d}") for i in range(1100)), (6, 2, "c d|e", "x"), (6, 2, "c|d|e", "y"),
    *((5, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1100)),
]


def brute(turns, part=c.PART):
    rows = [(a, -1 if t is None else t, (r or "").strip(" ") or "unknown", (x or "").replace("<|", "<\\|")) for a, t, r, x in turns]
    out = []
    for conv in {x[0] for x in rows}:
        cells: dict = {}
        for _, t, who, text in sorted(x for x in rows if x[0] == conv):
            cells.setdefault(max(0, t // part), []).append((who, text))
        cells = {(k, j): said[j * part : (j + 1) * part] for k, said in cells.items() for j in range(-(-len(said) // part))}
        leads = sorted((t, text) for a, t, who, text in rows if a == conv and who == "system")
        where = next((k for k in sorted(cells) if ("system", leads[0][1]) in cells[k]), None) if leads else None
        for viewer in {x[2] for x in rows if x[0] == conv} - {"system"}:
            for k, said in cells.items():
                text, spans = "", []
                for who, body in ([("system", leads[0][1])] if leads and where < k else []) + said:
                    name = "".join("_" if ch in "|<>" or ch <= " " else ch for ch in who)
                    name += "" if name == who else "~" + hashlib.md5(who.encode()).hexdigest()[:6]
                    text += "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == viewer else f"<|user name={name}|>\n"
                    if who == viewer:
                        spans.append((len(text), len(text) + len(body + c.END)))
                    text += body + c.END
                out.append((conv, viewer, *k, len(said), text, spans))
    return sorted(out, key=str)


def test_views_equal_brute_force(spark):
    table = spark.createDataFrame([(*t, "p", "s") for t in TURNS], SCHEMA).repartition(4)
    got = [(r.conv_id, r.speaker, r.part, r.piece, r.n_turns, r.rendered, [tuple(s) for s in r.spans]) for r in c.rotate(table).collect()]
    assert sorted(got, key=str) == brute(TURNS)
    assert c.digest(c.rotate(table)).where("conv_id = 5").count() == 8


def test_empty_table(spark):
    assert c.digest(c.rotate(spark.createDataFrame([], SCHEMA))).count() == 0
