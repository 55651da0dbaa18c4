"""Tolerant JSON on faults with stated answers, visible text against a tree."""

import json
import random

from pyspark.sql import functions as F

from sieveworks.functions import html
from sieveworks.functions.mending import mended
from sieveworks.operators import signals as S

QUOTES = ["plain", "they say yes", "a, b and c", "it's fine", "ends: here", "x {y} [z]", "ünï — “so”", "100 % (net)", "a / b // c", "q: r, s"]


def entry(i, quote):
    return {"signal_id": f"s{i}", "signal_state": "yes", "evidence_text": quote, "n": i}


def base(quotes):
    return {"signals": [entry(i, q) for i, q in enumerate(quotes)], "sales_angle": ["x", "y"], "flag": True, "none": None}


def faults(quotes):
    """(name, faulty text, what it means)"""
    want = base(quotes)
    text = json.dumps(want, ensure_ascii=False)
    odd = 'said "yes", twice'
    yield "prose before", "Here is {the} JSON you asked for:\n" + text, want
    yield "prose behind", text + "\nI hope that {this} helps.", want
    yield "unclosed", text.rstrip("}"), want
    yield "unclosed twice", text[: text.index(', "flag"')].rstrip("]"), {k: want[k] for k in ("signals", "sales_angle")}
    yield "missing comma between entries", text.replace("}, {", "} {"), want
    yield "missing comma between keys", text.replace(', "signal_state"', ' "signal_state"'), want
    yield "missing comma and a line end", text.replace(', "sales_angle"', '\n"sales_angle"'), want
    yield "trailing commas", text.replace("}]", "},]").replace('"y"]', '"y",]').replace("null}", "null,}"), want
    yield "typographic quotes and a trailing comma", text.replace('"x", "y"', "“x”, “y”,"), want
    yield "Python words", text.replace("true", "True").replace("null", "None"), want
    yield "bare keys", text.replace('"signal_id"', "signal_id").replace('"flag"', "flag"), want
    yield "single quotes", text.replace('"yes"', "'yes'"), want
    yield "inner quotes", text.replace(json.dumps(quotes[0], ensure_ascii=False), f'"{odd}"'), base([odd, *quotes[1:]])
    yield "inner quotes at the end", text.replace(json.dumps(quotes[0], ensure_ascii=False), '"all "new""'), base(['all "new"', *quotes[1:]])
    yield "inner quotes in a list", text.replace('"x"', '"we "may", perhaps"'), want | {"sales_angle": ['we "may", perhaps', "y"]}
    yield "line ends", text.replace(json.dumps(quotes[0], ensure_ascii=False), '"two\nlines\tand tab"'), base(["two lines and tab", *quotes[1:]])
    yield "bad escape", text.replace(json.dumps(quotes[0], ensure_ascii=False), r'"a \' b \d"'), base(["a ' b d", *quotes[1:]])
    yield "wrong closing mark", text.replace('"y"]', '"y"}')[:-1], {k: want[k] for k in ("signals", "sales_angle")}
    yield "stray closing mark", text.replace('"x", ', '"x"), '.replace(")", "")), want
    yield "comments", text.replace('"flag"', '/* note */ "flag"').replace('"none"', '// so\n"none"'), want


def test_two_hundred_faults():
    n = 0
    for k in range(10):
        quotes = QUOTES[k:] + QUOTES[:k]
        for name, text, want in faults(quotes[:3]):
            assert json.loads(mended(text, ("signals", "sales_angle"))) == want, (name, text)
            n += 1
    assert n == 200


def test_every_cut_keeps_what_was_complete():
    want = base(QUOTES[:4])
    text = json.dumps(want, ensure_ascii=False)
    ends = []  # where each entry is complete
    for e in want["signals"]:
        own = json.dumps(e, ensure_ascii=False)
        ends.append(text.index(own) + len(own))
    for cut in range(1, len(text)):
        got = json.loads(mended(text[:cut]))
        held = got.get("signals", [])
        whole = [e for e, end in zip(want["signals"], ends, strict=True) if end <= cut]
        assert held[: len(whole)] == whole
        assert all(want["signals"][i].get(k) == v for i, e in enumerate(held) for k, v in e.items()), (cut, held)


def test_odd_texts():
    assert mended(None) is None and mended("") is None and mended("no object") is None and mended('{"signals": []}', ("signals", "sales_angle")) is None
    assert json.loads(mended('{"a": "' + 'x "y" ' * 20_000 + '"}'))["a"].count('"') == 40_000  # inner quotes cost no more than their number
    assert mended('{"a": ' + "[" * 100_000) is None
    assert json.loads(mended('{"a": 1, "b": 2, "b": 3')) == {"a": 1, "b": 2}  # a number that the end may have cut off is left out


def test_proper_json_is_never_changed(spark):
    rng = random.Random(1)
    quote = lambda: "".join(rng.choices('ab "\\,:{}[]\'“”é/', k=rng.randint(0, 20)))
    rows = [(i, json.dumps({"signals": [{"signal_id": "a", "evidence_text": quote()}], "sales_angle": [quote()]})) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", S.parsed_response(F.col("t")).alias("p")).collect()
    for r in got:
        want = json.loads(rows[r["i"]][1])
        assert r["p"]["signals"][0]["evidence_text"] == want["signals"][0]["evidence_text"] and r["p"]["sales_angle"] == want["sales_angle"]


# --- visible text ----------------------------------------------------------------------------------------------------


def shown(nodes, skip=False):
    """Text of a tree of (tag, children) and texts, as a walk over it sees it."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            out += [n] if not skip and n.strip() else []
        else:
            out += shown(n[1], skip or n[0] in ("nav", "footer", "form", "header"))
    return out


def test_nesting_against_a_tree():
    rng = random.Random(7)
    words = iter(f"w{i}" for i in range(10**6))

    def tree(depth):
        return [next(words) if depth == 0 or rng.random() < 0.5 else (rng.choice(["div", "span", "nav", "footer", "b", "section", "form"]), tree(depth - 1)) for _ in range(rng.randint(1, 4))]

    def page(nodes):
        out = ""
        for n in nodes:
            if isinstance(n, str):
                out += n + " "
            else:
                inner = page(n[1])
                # End tags that match nothing open are noise; inner inline elements may lack theirs, as the outer one ends them.
                stray = rng.choice(["", "", "</em>", "</aside>", "</ul>", "</option>"])
                open_tail = rng.choice(["", "", "<i>", "<u>"])
                out += f"<{n[0]}>{stray}{inner}{open_tail}</{n[0]}>"
        return out

    for _ in range(300):
        nodes = tree(4)
        assert html.visible(page(nodes)).split() == " ".join(shown(nodes)).split()


def test_visible_text_cases():
    assert html.visible("<footer>a</nav>LEAK</footer>b") == "b"
    assert html.visible("<nav>x<div>y</nav>z</div>w") == ""  # the div outranks </nav>, which is lost, so the nav stays open
    assert html.visible("<nav><span>x</nav>y") == "y"
    assert html.visible("<head><title>t</title><p>body text") == "body text"
    assert html.visible("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a\nb\n1\n2\n3"
    assert html.visible('<img alt="A" title="A" src="https://x/y/A?z=1"><img alt="b" src="/p?q/c.png?v"><img title="t"><img>') == "[image: A]\n[image: b | c.png]\n[image: t]"
    assert html.visible("<script>if (a < b) { x('</p>') }</script>ok<style>p{}</style>") == "ok"
    assert html.visible(None) == "" and html.visible("</div></p>x") == "x"
