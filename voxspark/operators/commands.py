"""Commands: matching, risk rules, recipes, privacy, screen elements."""

from __future__ import annotations

import re
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rx import S, word

# fixed values
SERVICES = [("Spotify", "spotify"), ("YouTube", "you ?tube"), ("Apple Music", "apple music")]
ALIASES = {"calculator": "calc", "calc": "calc", "paint": "mspaint", "paint 3d": "mspaint", "notepad": "notepad", "wordpad": "wordpad", "cmd": "cmd", "command prompt": "cmd", "terminal": "wt", "powershell": "powershell",
           "explorer": "explorer", "file explorer": "explorer", "task manager": "taskmgr", "control panel": "control", "registry": "regedit", "registry editor": "regedit"}
GOAL_RULES = [
    ("refuse", word(r"buy|purchase|order|check\s?out|pay(?:\s+for)?|payment|subscribe"), "Agent mode never spends money"),
    ("refuse", word(r"send|transfer|wire|venmo|zelle|cash\s?app") + r".{0,24}(?:money|\$|dollars|crypto|bitcoin|" + word("eth", "") + ")", "Agent mode never moves money"),
    ("refuse", word(r"password|passcode|credentials?|2fa|verification code|credit card|cvv|ssn|social security"), "Agent mode never handles passwords or sensitive credentials"),
    ("refuse", word(r"log\s?in|sign\s?in|log\s?into|sign\s?into"), "Agent mode never signs into accounts — do that yourself once, then ask again"),
    ("refuse", word("delete|erase|wipe|format") + ".{0,24}" + word("all|every|everything|folder|drive|disk", ""), "Bulk deletion is irreversible"),
    ("confirm", word("message|text|dm|email|e-mail|reply|respond"), "This will contact someone as you"),
    ("confirm", word("post|publish|tweet|share"), "This will publish content as you"),
    ("confirm", word("send"), "This may send something to someone as you"),
]
CLICK_RULES = [
    ("refuse", word("password|passcode|cvv|card number"), "Credential field — agent mode never touches these"),
    ("confirm", word(r"buy|purchase|place order|pay|check\s?out|confirm (?:order|purchase|payment)|subscribe|add to cart"), "This button commits a purchase"),
    ("confirm", word("send|post|publish|tweet|reply"), "This button sends content to someone"),
    ("confirm", word("delete|remove|uninstall|erase|discard|empty (?:trash|recycle)"), "This button deletes something"),
]
EXECUTABLE = r"(?i)\.(?:exe|bat|cmd|ps1|msi|vbs|scr|reg|lnk|jar|com|app|sh|command)\s*$"
PERSONAL = [
    (r"(?i)[A-Za-z]:\\Users\\[^\\/*?\"<>|]+", "a user profile path"), (r"/(?:home|Users)/[^/\s]+", "a user profile path"), (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", "an email address"),
    (r"\+?\d[\d\s().-]{7,}\d", "a phone number"), (word(r"(?:\d[ -]*?){13,16}", ""), "a card-like number"), (word(r"password|passcode|api[_\s-]?key|secret|token"), "a credential"),
]
MAX_LITERAL = 60


def _each(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def tidy_command(c: Column) -> Column:
    return F.trim(_each(F.trim(c), (r"(?i)^(?:(?:hey|ok|okay|please|could you|can you|would you|scribe)[,\s]+)+", ""), (r"[.!?]+$", "")))


def tidy_query(c: Column) -> Column:
    return F.trim(_each(c, (r"(?i)\s+(?:for me|please|thanks|thank you)$", ""), (r"(?i)^(?:the|a|an)\s+", ""), (r"[.!?]+$", "")))


def match_fast_path(c: Column) -> Column:
    """struct(tool, args, via) of the first rule that fits, else null."""
    t = tidy_command(c)
    kind = "struct<tool:string,args:map<string,string>,via:string>"
    hit = lambda tool, via, **args: F.struct(F.lit(tool).alias("tool"), F.create_map(*(x for k, v in args.items() for x in (F.lit(k), v))).alias("args"), F.lit(via).alias("via"))
    rules: list[tuple[Column, Column]] = []
    for label, name in SERVICES:
        for p in (r"(?i)^play\s+(.+?)\s+(?:on|in|with|using)\s+.*$", r"(?i)^(?:open|launch|start)?\s*\w*\s*(?:and\s+)?play\s+(.+)$"):
            q = _each(F.regexp_extract(t, p, 1), (r"(?i)\s+(?:for me|please|thanks|thank you)$", ""))
            q = tidy_query(_each(tidy_query(q), (word(name), ""), (r"(?i)\s+(?:on|in|with|using)\s*$", "")))
            rules.append((t.rlike(word(name)) & (q != ""), hit("play_media", "media", query=q, service=F.lit(label))))
    for p in (r"(?i)^(?:search (?:the )?web for|google|search google for)\s+(.+)$", r"(?i)^(?:search|look up|find)\s+(?:for\s+)?(.+?)\s+on\s+google$"):
        q = tidy_query(F.regexp_extract(t, p, 1))
        rules.append((q != "", hit("search_web", "search", query=q)))
    for p in (r"(?i)^search\s+(?:for\s+)?(.+?)\s+on\s+you\s?tube$", r"(?i)^search\s+you\s?tube\s+for\s+(.+)$"):
        q = tidy_query(F.regexp_extract(t, p, 1))
        rules.append((q != "", hit("play_media", "youtube-search", query=q, service=F.lit("YouTube"))))
    q = tidy_query(F.regexp_extract(t, r"(?i)^(?:open|launch|start|go to)\s+(.+)$", 1))
    rules.append(((q != "") & ~q.rlike(word("and|then") + r"|(?<=[A-Za-z0-9_]),(?=[A-Za-z0-9_])"), hit("open_target", "open", target=q)))
    out = F.lit(None).cast(kind)
    for cond, value in reversed(rules):
        out = F.when(cond, value).otherwise(out)
    return out


def encode_component(c: Column) -> Column:
    return _each(F.url_encode(c), (r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def media_link(service: Column, query: Column, app: bool = True) -> Column:
    q = encode_component(query)
    spotify = F.concat(F.lit("spotify:search:" if app else "https://open.spotify.com/search/"), q)
    return F.when(service == "Spotify", spotify).when(service == "YouTube", F.concat(F.lit("https://www.youtube.com/results?search_query="), q)).when(service == "Apple Music", F.concat(F.lit("https://music.apple.com/search?term="), q))


def search_url(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="), encode_component(query))


def _risk(c: Column, rules: list[tuple[str, str, str]]) -> Column:
    level, reason = F.lit("auto"), F.lit(None).cast("string")
    for lv, rx, why in reversed(rules):
        hit = c.rlike(rx)
        level, reason = F.when(hit, lv).otherwise(level), F.when(hit, why).otherwise(reason)
    return F.struct(level.alias("level"), reason.alias("reason"))


def assess_goal(c: Column) -> Column:
    return _risk(c, GOAL_RULES)


def assess_click(c: Column) -> Column:
    return _risk(F.trim(F.coalesce(c, F.lit(""))), CLICK_RULES)


def risk_of_opening(c: Column) -> Column:
    t = F.trim(c)
    runs = ~t.rlike("(?i)^https?://") & t.rlike(EXECUTABLE)
    return F.struct(F.when(runs, "confirm").otherwise("auto").alias("level"), F.when(runs, "This would run an executable file").alias("reason"))


def assess_command(tool: Column, args: Column) -> Column:
    """Goals for the agent, targets for opening, all other known tools are safe; unknown ones are errors."""
    safe = F.struct(F.lit("auto").alias("level"), F.lit(None).cast("string").alias("reason"))
    bad = F.struct(F.lit("error").alias("level"), F.concat(F.lit("unknown tool "), tool).alias("reason"))
    return F.when(tool == "computer_task", assess_goal(F.coalesce(args["goal"], F.lit("")))).when(tool == "open_target", risk_of_opening(F.coalesce(args["target"], F.lit("")))).when(tool.isin("play_media", "search_web", "read_history", "type_text", "none"), safe).otherwise(bad)


#: Patterns without a word of their own, such as {what}, that are broadcast to the texts.
OPEN_BROADCAST = 20_000
#: A limit of such patterns that an owner of recipes may set; none by default.
MAX_OPEN_PATTERNS: int | None = None


def _tidy(c: Column) -> Column:
    return F.trim(_each(c, (f"{S}+", " "), (r"[.!?,]+$", "")))


def _open_pairs(u: DataFrame, wide: DataFrame, key: str, few: bool) -> DataFrame:
    """Texts with the patterns that begin or end as they do, and with those between slots that hold the pattern's longest part."""
    # white space of a pattern stands for the one blank that a text has there; the patterns' case is that of ASCII
    low = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)
    plain = low(F.regexp_replace(F.trim("pattern"), r"\s+", " "))
    parts = F.split(plain, r"\{\w+\}", -1)
    # quotes of the expression, and a line break that $ passes over, are left to it
    odd = plain.rlike(r"\\e|\x{0085}")
    ends = wide.withColumns({"head": F.when(odd, "").otherwise(F.get(parts, F.lit(0))), "tail": F.when(odd, "").otherwise(F.element_at(parts, -1)), "inner": F.when(odd, F.array(F.lit(""))).otherwise(parts)})
    ends = ends.withColumn("at_head", F.length("head") >= F.length("tail")).withColumn("part", F.when(F.col("at_head"), F.col("head")).otherwise(F.col("tail"))).drop("head", "tail")
    small = F.broadcast if few else (lambda df: df)
    t = low(F.col("t"))
    # the longest part between slots
    bare = ends.where("part = ''").withColumn("inner", F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    met = u.withColumn("low", t).join(small(bare), F.expr("contains(low, inner) and t rlike rx")).select(key, "t", *wide.columns)
    sizes = [tuple(r) for r in ends.where("part <> ''").select("at_head", F.length("part").alias("n")).distinct().collect()]  # a few numbers
    if not sizes:
        return met
    last = F.regexp_replace(t, r"\x{0085}\z", "")
    cut = F.array(*(F.struct(F.lit(at_head).alias("t_head"), (F.substring(t, 1, n) if at_head else F.substring(last, -n, n)).alias("t_part")) for at_head, n in sizes))
    texts = u.select(key, "t", F.explode(cut).alias("x")).select(key, "t", "x.*")
    same = (F.col("t_head") == F.col("at_head")) & (F.col("t_part") == F.col("part"))
    return met.unionByName(texts.join(small(ends.where("part <> ''")), same).select(key, "t", *wide.columns))


def match_recipes(utterances: DataFrame, recipes: DataFrame, key: str = "utterance_id", text: str = "text") -> DataFrame:
    """key, recipe_id, slots (map): the matching pattern with the most literal characters, else the first.

    A pattern meets the texts that hold the one of its words which the fewest texts hold (an
    equi-join).  Of patterns without a word of their own those alike count once; one that begins or ends with letters
    meets the texts that begin or end so (an equi-join, too), the others are asked of all texts.
    """
    p = recipes.where("not coalesce(stats.quarantined, false)").select(F.col("id").alias("recipe_id"), F.col("slots").alias("wanted"), F.monotonically_increasing_id().alias("r"), F.posexplode("patterns").alias("p", "pattern"))
    quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(F.regexp_replace(F.trim("pattern"), r"\{(\w+)\}", r"\\E(.+?)\\Q"), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    own = F.filter(F.split(F.lower(F.trim("pattern")), r"\s+"), lambda w: ~w.contains("{") & ~w.contains("}") & (w != ""))
    p = p.select("*", F.concat(F.lit("(?i)^"), quoted, F.lit("$")).alias("rx"), F.regexp_extract_all("pattern", F.lit(r"\{(\w+)\}"), 1).alias("names"), F.length(F.regexp_replace("pattern", r"\{\w+\}", "")).alias("literal"), F.array_distinct(own).alias("own"))
    u = utterances.select(key, _tidy(F.col(text)).alias("t"))
    words = u.select(key, "t", F.explode(F.array_distinct(F.split(F.lower("t"), " "))).alias("word"))
    held = p.select("recipe_id", "p", F.explode("own").alias("word")).join(words.groupBy("word").agg(F.count("*").alias("df")), "word", "left")
    rare = held.groupBy("recipe_id", "p").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("k")).select("recipe_id", "p", F.col("k.word").alias("word"))
    every = words.join(p.join(rare, ["recipe_id", "p"]), "word").select(key, "t", *p.columns)
    alike = F.min(F.struct((-F.col("literal")).alias("l"), *(c for c in p.columns if c not in ("rx", "wanted")))).alias("b")
    wide = p.where(F.size("own") == 0).groupBy("rx", "wanted").agg(alike).select(*(F.col(c) if c in ("rx", "wanted") else F.col(f"b.{c}") for c in p.columns))
    n_wide = wide.count()
    if MAX_OPEN_PATTERNS is not None and n_wide > MAX_OPEN_PATTERNS:
        raise ValueError(f"over {MAX_OPEN_PATTERNS} patterns without a word of their own")
    if n_wide:
        every = every.unionByName(_open_pairs(u, wide, key, n_wide <= OPEN_BROADCAST).select(key, "t", *p.columns))
    hit = every.where(F.expr("t rlike rx"))
    # captured values: each group in turn
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.size("names"), F.lit(1))), lambda i: _tidy(F.when(i <= F.size("names"), F.call_function("regexp_extract", F.col("t"), F.col("rx"), i)).otherwise("")))
    hit = hit.withColumn("slots", F.when(F.size("names") > 0, F.map_from_arrays("names", F.slice(values, 1, F.greatest(F.size("names"), F.lit(1))))).otherwise(F.create_map().cast("map<string,string>")))
    hit = hit.where(~F.exists("wanted", lambda s: F.coalesce(F.element_at(F.col("slots"), s), F.lit("")) == ""))
    best = hit.groupBy(key).agg(F.min(F.struct((-F.col("literal")).alias("l"), "r", "p", "recipe_id", F.map_entries("slots").alias("e"))).alias("b"))
    return best.select(key, F.col("b.recipe_id").alias("recipe_id"), F.map_from_entries("b.e").alias("slots"))


def interpolate(template: Column, slots: Column) -> Column:
    """{{name}} becomes the slot's value; unknown names become nothing."""
    filled = F.aggregate(F.map_entries(slots), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))
    return F.regexp_replace(filled, r"\{\{\w+\}\}", "")


def resolve_recipe_set(builtin: DataFrame, learned: DataFrame) -> DataFrame:
    return learned.unionByName(builtin.join(learned.select("id"), "id", "left_anti"), allowMissingColumns=True)


def check_literal(c: Column) -> Column:
    v = F.trim(c)
    reason = F.when(F.length(v) > MAX_LITERAL, "is long free text (looks like user content, not a UI label)")
    for rx, what in reversed(PERSONAL):
        reason = F.when(v.rlike(rx), f"contains {what}").otherwise(reason)
    reason = F.when(v == "", None).otherwise(reason)
    # by way of an array, so that the patterns are asked once
    return F.get(F.transform(F.array(reason), lambda r: F.struct(r.isNull().alias("ok"), r.alias("reason"))), F.lit(0))


def recipe_literals(recipes: DataFrame) -> DataFrame:
    """id, pos, source, literal: all texts that a recipe would keep, in order."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\{\{\w+\}\}", ""))
    none = F.array().cast("array<string>")
    s = recipes.select("id", F.posexplode("steps").alias("i", "s"))
    a = F.col("s.action")
    texts = F.when(a == "launch", F.array("s.app")).when(a == "deeplink", F.array(bare(F.col("s.uri")))).when(a == "type", F.array(bare(F.col("s.text")), F.col("s.target.name"))).when(a.isin("click", "waitFor"), F.array("s.target.name")).when(a == "key", F.coalesce("s.keys", none)).otherwise(none)
    steps = s.select("id", "i", F.concat(F.lit('step "'), a, F.lit('"')).alias("source"), F.posexplode(texts).alias("j", "literal"))
    pats = recipes.select("id", F.lit(1 << 20).alias("i"), F.lit("pattern").alias("source"), F.posexplode(F.transform("patterns", lambda p: F.trim(F.regexp_replace(p, r"\{\w+\}", "")))).alias("j", "literal"))
    return steps.unionAll(pats).where(F.coalesce("literal", F.lit("")) != "").select("id", (F.col("i").cast("long") * 1000 + F.col("j")).alias("pos"), "source", "literal")


def refused_recipes(recipes: DataFrame) -> DataFrame:
    """id, reason of the first literal that isn't safe."""
    t = recipe_literals(recipes).withColumn("v", check_literal(F.col("literal"))).where("not v.ok")
    return t.groupBy("id").agg(F.min_by(F.concat_ws(" ", "source", "v.reason"), "pos").alias("reason"))


def shareable_recipes(recipes: DataFrame) -> DataFrame:
    return recipes.join(refused_recipes(recipes).select("id"), "id", "left_anti")


def typed_text_ok(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\{\{\w+\}\}", ""))
    return (bare == "") | check_literal(bare)["ok"]


_PERSONAL_PY = [(re.compile(rx.replace("(?i)", ""), re.A | (re.I if "(?i)" in rx else 0)), what) for rx, what in PERSONAL]


def _unsafe(v: str) -> str | None:
    v = v.strip()
    hit = next((f"contains {what}" for rx, what in _PERSONAL_PY if rx.search(v)), None)
    return hit or ("is long free text (looks like user content, not a UI label)" if len(v) > MAX_LITERAL else None)


def _record(utterance: str, actions: list) -> dict:
    tidy = lambda s: re.sub(r"[.!?,]+$", "", re.sub(r"\s+", " ", s or "")).strip()
    low = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    said, slots, count, steps = tidy(utterance), {}, 0, []
    refuse = lambda why: {"ok": False, "reason": why, "pattern": None, "slots": None, "steps": None}

    def slot(value: str, hint: str) -> str | None:
        nonlocal count
        v = tidy(value)
        if not v or low(v) not in low(said):
            return None
        name = next((k for k, x in slots.items() if low(x) == low(v)), None)
        if name is None:
            if " " in v and hint == "text":
                count += 1
                name = hint if count == 1 else f"{hint}{count}"
            else:
                name = f"{hint}{count or ''}"
            if name in slots:
                count += 1
                name = f"{hint}{count}"
            slots[name] = v
        return "{{" + name + "}}"

    for a in actions:
        kind = a["kind"]
        if kind == "launch" and a["app"]:
            steps.append(("launch", a["app"]))
        elif kind == "key" and a["keys"] is not None and len(a["keys"]):
            steps += [("key", k) for k in a["keys"]]
        elif kind == "click":
            if not a["label"]:
                return refuse("a click had no label to match on later")
            s = slot(a["label"], "target")
            steps.append(("click", s or a["label"]))
        elif kind == "type":
            s = slot(a["text"], "text") if a["text"] else None
            if a["text"] and not s and (why := _unsafe(a["text"])):
                return refuse(f"typed text {why}")
            steps.append(("type", s or a["text"] or ""))
            if a["label"]:
                steps.append(("type", a["label"]))
    if not steps:
        return refuse("nothing worth recording")
    pattern = said
    for name, v in slots.items():
        pattern = re.sub(re.escape(v), lambda _m, n=name: "{" + n + "}", pattern, count=1, flags=re.I)
    for action, text in [*steps, ("", re.sub(r"\{\w+\}", "", pattern))]:
        if why := _unsafe(re.sub(r"\{\{\w+\}\}", "", text)):
            return refuse(f'step "{action}" {why}' if action else f"pattern {why}")
    return {"ok": True, "reason": None, "pattern": pattern, "slots": list(slots), "steps": [f"{a}:{t}" for a, t in steps]}


def record_recipes(actions: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """From logs of actions (kind, app, label, text, keys by pos) and utterances: a recipe or why not."""
    lists = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "app", "label", "text", "keys"))).alias("a"))

    @F.pandas_udf("ok boolean, reason string, pattern string, slots array<string>, steps array<string>")
    def run(u: pd.Series, a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_record(x or "", [] if y is None else list(y)) for x, y in zip(u, a, strict=True)], columns=["ok", "reason", "pattern", "slots", "steps"])

    return runs.join(lists, key, "left").select(key, run("utterance", "a").alias("r")).select(key, "r.*")


def recipe_stats(outcomes: DataFrame) -> DataFrame:
    last = outcomes.groupBy("recipe_id").agg(F.sum(F.col("ok").cast("long")).alias("successes"), F.max(F.when(F.col("ok"), F.col("seq"))).alias("last"))
    f = outcomes.where("not ok").join(last, "recipe_id").where("last is null or seq > last").groupBy("recipe_id").agg(F.count("*").alias("failures"))
    return last.join(f, "recipe_id", "left").select("recipe_id", "successes", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), (F.coalesce("failures", F.lit(0)) >= 3).alias("quarantined"))


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def label_matches(candidate: Column, wanted: Column) -> Column:
    pad = lambda c: F.concat(F.lit(" "), norm(c), F.lit(" "))
    return (norm(candidate) != "") & (norm(wanted) != "") & (F.instr(pad(candidate), pad(wanted)) > 0)


def resolve_selectors(selectors: DataFrame, elements: DataFrame) -> DataFrame:
    """selector_id, element_id or reason; selectors (selector_id, snapshot_id, name, type, invokable, editable)."""
    s = selectors.withColumnsRenamed({"name": "wanted", "type": "want_type"})
    j = s.join(elements, "snapshot_id", "left")
    pool = F.col("id").isNotNull() & (F.col("want_type").isNull() | (norm(F.col("type")) == norm(F.col("want_type")))) & (~F.coalesce("invokable", F.lit(False)) | F.col("invoke")) & (~F.coalesce("editable", F.lit(False)) | F.col("value"))
    blank = F.coalesce(F.col("wanted"), F.lit("")) == ""
    exact, loose = pool & (norm(F.col("name")) == norm(F.col("wanted"))), pool & label_matches(F.col("name"), F.col("wanted"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    one = lambda c: F.min(F.when(c, F.col("id")))
    g = j.groupBy("selector_id", "wanted").agg(n(pool).alias("np"), n(exact).alias("ne"), n(loose).alias("nl"), one(pool).alias("p"), one(exact).alias("e"), one(loose).alias("l"))
    many = lambda c: F.concat(F.lit('"'), F.col("wanted"), F.lit('" matches '), c.cast("string"), F.lit(" controls"))
    ident = F.when(blank, F.when(F.col("np") == 1, F.col("p"))).when(F.col("ne") == 1, F.col("e")).when((F.col("ne") == 0) & (F.col("nl") == 1), F.col("l"))
    why = F.when(ident.isNotNull(), None).when(blank, F.when(F.col("np") > 0, "selector is ambiguous (no label given)").otherwise("no matching control")).when(F.col("ne") > 1, many(F.col("ne"))).when(F.col("nl") > 1, many(F.col("nl"))).otherwise(F.concat(F.lit('no control matching "'), F.col("wanted"), F.lit('"')))
    return g.select("selector_id", ident.alias("element_id"), why.alias("reason"))


def title_matches(candidate: Column, query: Column) -> Column:
    """The normalised query inside the candidate, or its words there in order."""
    c, q = norm(candidate), norm(query)
    return (c != "") & (q != "") & F.rlike(c, F.concat(F.lit("^.*?"), F.replace(q, F.lit(" "), F.lit(".*?"))))


def find_play_button(elements: DataFrame, queries: DataFrame, window: int = 12) -> DataFrame:
    """snapshot_id, element_id: a play control that names the title, else the first bare one soon after the title."""
    name = F.trim("name")
    e = elements.join(queries, "snapshot_id").withColumn("play", F.col("invoke") & name.rlike(r"(?i)^play(?![A-Za-z0-9_])"))
    label = F.regexp_replace(name, r"(?i)^play\s+", "")
    e = e.withColumns({"own": F.col("play") & (label != "") & title_matches(label, F.col("query")), "title": (name != "") & title_matches(name, F.col("query")), "bare": F.col("play") & name.rlike("(?i)^play$")})
    first = e.groupBy("snapshot_id").agg(F.min_by("id", F.when(F.col("own"), F.col("pos"))).alias("own_id"), F.min(F.when(F.col("title"), F.col("pos"))).alias("m"))
    near = e.join(first.select("snapshot_id", "m"), "snapshot_id").where(F.col("bare") & (F.col("pos") > F.col("m")) & (F.col("pos") <= F.col("m") + window)).groupBy("snapshot_id").agg(F.min_by("id", "pos").alias("near_id"))
    has_own = e.where("own").select("snapshot_id").distinct().withColumn("h", F.lit(True))
    return queries.join(first, "snapshot_id", "left").join(near, "snapshot_id", "left").join(has_own, "snapshot_id", "left").select("snapshot_id", F.when(F.col("h"), F.col("own_id")).otherwise(F.col("near_id")).alias("element_id"))


def _grams(c: str, k: int) -> Column:
    """All parts of k characters."""
    parts = F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(F.col(c), i, F.lit(k)))
    return F.when(F.length(c) >= k, parts).otherwise(F.array().cast("array<string>"))


def match_app_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, match, tier: an alias, else an equal, the shortest starting with, the shortest containing name."""
    solid = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    alias = queries.sparkSession.createDataFrame(list(ALIASES.items()), "said string, target string")
    q = queries.select("query_id", F.lower(F.trim("query")).alias("said"), solid(F.col("query")).alias("q")).join(F.broadcast(alias), "said", "left")
    # of names that are alike without their marks, one stands for all
    n = names.select("name", solid(F.col("name")).alias("n")).where("n <> ''").groupBy("n").agg(F.min(F.struct(F.length("name").alias("l"), "name")).alias("b"))
    index = n.select("n", "b", F.explode(F.array_distinct(F.concat(*(_grams("n", k) for k in (1, 2, 3))))).alias("gram"))
    asked = q.where("target is null and q <> ''").select("q").distinct()
    own = asked.select("q", F.explode(F.array_distinct(F.when(F.length("q") < 3, F.array("q")).otherwise(_grams("q", 3)))).alias("gram"))
    # a name that contains the query has all of its grams: the rarest one leads to the fewest names
    counts = own.join(index.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left")
    rare = counts.groupBy("q").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).select("q", F.col("r.gram").alias("gram"))
    hit = rare.join(index, "gram").where(F.col("n").contains(F.col("q"))).withColumn("tier", F.when(F.col("n") == F.col("q"), 0).when(F.col("n").startswith(F.col("q")), 1).otherwise(2))
    best = hit.groupBy("q").agg(F.min(F.struct("tier", "b.l", "b.name")).alias("b")).withColumnRenamed("q", "bq")
    return q.join(best, (q["q"] == F.col("bq")) & q["target"].isNull(), "left").select("query_id", F.coalesce("target", "b.name").alias("match"), F.when(F.col("target").isNotNull(), "alias").when(F.col("b.tier") == 0, "exact").when(F.col("b.tier") == 1, "prefix").when(F.col("b.tier") == 2, "contains").alias("tier"))


def action_loops(df: DataFrame, run: str = "run_id", pos: str = "pos", times: int = 3) -> DataFrame:
    """Rows where the same action comes for the third time in a row."""
    w = Window.partitionBy(run).orderBy(pos)
    a = F.to_json(F.struct("tool", "args"))
    same = reduce(lambda x, k: x & (F.lag(a, k).over(w) == a), range(1, times), F.lit(True))
    return df.withColumn("looping", F.coalesce(same, F.lit(False)))


def format_elements(elements: DataFrame, most: int = 110) -> DataFrame:
    w = Window.partitionBy("snapshot_id").orderBy("pos")
    label = F.substring(F.regexp_replace(F.when(F.coalesce("name", F.lit("")) == "", "(no label)").otherwise(F.col("name")), r"\s+", " "), 1, 80)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit('] "'), label, F.lit('" ('), F.when(F.col("value"), "input").otherwise(F.lower("type")), F.lit(")"))
    e = elements.withColumns({"r": F.row_number().over(w), "line": line})
    g = e.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "line")))).alias("l"), F.count("*").alias("n"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return g.select("snapshot_id", F.when(F.col("n") > most, F.concat(text, F.lit("\n…and "), (F.col("n") - most).cast("string"), F.lit(" more (scroll to reveal)"))).otherwise(text).alias("text"))


STAGES = ["done", "clarify", "cancelled", "refused", "error"]


def command_funnel(events: DataFrame, by: str = "day") -> DataFrame:
    """By day: runs per last stage, share of proposals that went on, runs by what served them."""
    last = events.groupBy("run_id").agg(F.max_by("stage", F.struct("ts", "stage")).alias("stage"), F.max(by).alias(by), F.max((F.col("stage") == "confirm").cast("int")).alias("proposed"), F.max("via").alias("via"))
    counts = last.groupBy(by).pivot("stage", STAGES).count().fillna(0)
    ok = F.sum(F.col("proposed") * (F.col("stage") == "done").cast("int")) / F.sum("proposed")
    rest = last.groupBy(by).agg(F.round(F.when(F.sum("proposed") > 0, ok).otherwise(0.0), 4).alias("approval"), *(F.sum((F.col("via") == v).cast("long")).alias(f"via_{v}") for v in ("recipe", "fast", "router")))
    return counts.join(rest, by)
