import random
import re

from opsdesk.llm import quotes

A = "We should move the meeting to Thursday."
B = "Thursday works for everybody in the team."
C = "Then let us book the large room."


def test_threads(spark):
    rows = [
        (1, 0, A),
        (1, 1, "An unrelated remark that nobody answers"),
        (1, 2, f"> {A}\n\n{B}"),
        (1, 3, f">> we should MOVE   the meeting to thursday\n> {B}\n{C}"),
        (1, 4, f"> > {B}\n> {C}\nDone, the room is booked now."),
        (1, 5, f"> {A}\nI cannot come on that day."),
        (1, 6, "> a passage that nobody wrote here\nHello there, all of you."),
        (2, 0, f"> {A}\nOther conversation."),
        (3, 0, None), (3, 1, ""), (3, 2, "> yes\nok"), (3, 2, "> yes\nok"), (None, 1, f"> {A}"), (4, None, f"> {A}\nx"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'clash' as path", "1 as parent")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    parent = {k: r.parent_turn for k, r in got.items() if k[0] == 1}
    assert parent == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 3, (1, 5): 0, (1, 6): None}
    assert got[1, 4].path == [0, 2, 3, 4] and got[1, 4].depth == 3 and got[1, 4].text == "Done, the room is booked now."
    assert got[1, 6].unlinked == 1 and got[1, 6].text == "Hello there, all of you."
    assert got[2, 0].parent_turn is None and got[2, 0].unlinked == 1 and got[2, 0].text == "Other conversation."
    assert got[3, 0].text == "" and got[3, 2].text == "ok" and got[3, 2].quoted_lines == 1
    assert got[None, 1].path is None and got[4, None].text == "x"
    order = [r.turn for r in quotes.link_quotes(df).orderBy("conv_id", "path").collect() if r.conv_id == 1]
    assert order == [0, 2, 3, 4, 5, 1, 6]
    assert quotes.link_quotes(df).count() == len(rows) and quotes.link_quotes(df.limit(0)).count() == 0


def test_long_chain(spark):
    text = [f"message number {k} says something of its own" for k in range(70)]
    rows = [(7, k, t if not k else f"> {text[k - 1]}\n{t}") for k, t in enumerate(text)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).orderBy("turn").collect()
    assert [r.path for r in got] == [list(range(k + 1)) for k in range(70)]


def test_quotes_wrapped_anew_and_single_sentences(spark):
    long = "The first sentence of a long paragraph is here. The second one, with more to say, follows it at once! And a third?"
    rows = [
        (1, 0, long), (1, 1, "> The first sentence of a long\n> paragraph is here. The second one, with more to say,\n> follows it at once! And a\n> third?\nAll of it."),
        (1, 2, "> The second one, with more to say,\n> follows it at once!\nOne sentence."), (1, 3, "> ok\n> no\nShort."), (1, 4, ">\n> \nBlank."),
        (1, 5, "> The second one, with more\n\n> to say, follows it at once\nTwo passages of neither."),
    ]
    got = {r.turn: (r.parent_turn, r.unlinked) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (0, 0), 3: (None, 2), 4: (None, 0), 5: (None, 2)}


def brute(rows, least):
    """(conversation, turn) -> (parent, unlinked), message by message."""
    normal = lambda s: re.sub(" +", " ", re.sub(r"[!-/:-@\[-`{-~\s]+", " ", s).lower()).strip()

    def parts(text):
        out, last = [], None
        for line in (text or "").split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]*)*)", line)
            level = marks[1].count(">")
            body = line[marks.end() :] if level else line
            kind = level if body.strip(" \t\r\f\x0b") else -1
            if kind != last:
                out.append((kind, []))
            out[-1][1].append(body)
            last = kind
        return [(k, x) for k, x in out if k >= 0]

    def of(lines):
        body = " ".join(lines)
        return {"w": [normal(body)], "s": [normal(x) for x in re.split(r"(?<=[.!?])\s+", body)], "l": [normal(x) for x in lines]}

    first = {}
    for c, n, text in rows:
        for level, lines in parts(text):
            if level == 0:
                for x in sum(of(lines).values(), []):
                    if len(x) >= least:
                        first[c, x] = min(first.get((c, x), n), n)
    out = {}
    for c, n, text in rows:
        votes, unlinked = {}, 0
        for level, lines in parts(text):
            if level:
                known = {k: [x for x in xs if len(x) >= least and first.get((c, x), n) < n] for k, xs in of(lines).items()}
                for k, xs in known.items():
                    for x in xs:
                        key = (level, first[c, x])
                        votes.setdefault(key, {}).setdefault(k, 0)
                        votes[key][k] += len(x)
                if not known["w"] and not known["s"]:
                    unlinked += len(lines) - len(known["l"])
        best = max(((-level, max(v.values()), author) for (level, author), v in votes.items()), default=None)
        out[c, n] = (best[2] if best else None, unlinked)
    return out


def test_against_a_plain_version(spark):
    r = random.Random(3)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    rows = []
    for c in range(12):
        said = []
        for n in range(9):
            lines = []
            for _ in range(r.randint(0, 2)):
                if said:
                    text = r.choice(said)
                    if r.random() < 0.4:
                        text = r.choice(re.split(r"(?<=[.!?])\s+", text))
                    words = text.split(" ")
                    at = r.randint(1, len(words))
                    lines += [r.choice(["> ", ">> ", "> > "]) + " ".join(x) for x in (words[:at], words[at:]) if x]
                    lines += [""] * r.randint(0, 1)
            mine = " ".join(" ".join(word() for _ in range(r.randint(1, 5))) + r.choice(".!?") for _ in range(r.randint(1, 3)))
            said.append(mine)
            rows.append((c, n, "\n".join([*lines, *([""] if r.random() < 0.5 else []), mine])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(x.conv_id, x.turn): (x.parent_turn, x.unlinked) for x in quotes.link_quotes(df, min_chars=8).collect()}
    assert got == brute(rows, 8)
