"""Queries of the command operators, over commands made of part names and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as c
from .registry import query
from .text_queries import spread, table



def _k():
    return F.col("p_partkey")


def _said(spark, sf_dir):
    n, k = F.col("p_name"), _k() % 9
    text = (F.when(k == 0, F.concat(F.lit("Play "), n, F.lit(" on Spotify please."))).when(k == 1, F.concat(F.lit("hey scribe, open "), n)).when(k == 2, F.concat(F.lit("Could you search the web for "), n, F.lit("?")))
            .when(k == 3, F.concat(F.lit("search for "), n, F.lit(" on youtube"))).when(k == 4, F.concat(F.lit("open youtube and play "), n)).when(k == 5, F.concat(F.lit("open "), n, F.lit(" and then close it")))
            .when(k == 6, F.concat(F.lit("buy "), n)).when(k == 7, F.concat(F.lit("email the "), n, F.lit(" list"))).otherwise(F.concat(F.lit("look up the "), n, F.lit(" on google"))))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", text.alias("text"))


_SAID = """(SELECT p_partkey AS k, p_name AS n, CASE p_partkey % 9 WHEN 0 THEN 'Play ' || p_name || ' on Spotify please.' WHEN 1 THEN 'hey scribe, open ' || p_name WHEN 2 THEN 'Could you search the web for ' || p_name || '?' WHEN 3 THEN 'search for ' || p_name || ' on youtube' WHEN 4 THEN 'open youtube and play ' || p_name
WHEN 5 THEN 'open ' || p_name || ' and then close it' WHEN 6 THEN 'buy ' || p_name WHEN 7 THEN 'email the ' || p_name || ' list' ELSE 'look up the ' || p_name || ' on google' END AS text FROM part)"""


@query(f"SELECT k AS p_partkey, CASE k % 9 WHEN 0 THEN 'Play ' || n || ' on Spotify please' WHEN 1 THEN 'open ' || n WHEN 2 THEN 'search the web for ' || n ELSE text END AS command, CASE k % 9 WHEN 0 THEN 'Play ' || n || ' on Spotify please' WHEN 2 THEN 'Could you search the web for ' || n ELSE text END AS query FROM {_SAID}")
def f01_tidy(spark, sf_dir):
    return _said(spark, sf_dir).select("p_partkey", c.tidy_command(F.col("text")).alias("command"), c.tidy_query(F.col("text")).alias("query"))


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'play_media' WHEN 1 THEN 'open_target' WHEN 2 THEN 'search_web' WHEN 3 THEN 'play_media' WHEN 4 THEN 'play_media' WHEN 8 THEN 'search_web' END AS tool,
CASE WHEN p_partkey % 9 IN (0, 2, 3, 4, 8) THEN p_name END AS query, CASE WHEN p_partkey % 9 = 1 THEN p_name END AS target, CASE p_partkey % 9 WHEN 0 THEN 'Spotify' WHEN 3 THEN 'YouTube' WHEN 4 THEN 'YouTube' END AS service, CASE p_partkey % 9 WHEN 0 THEN 'media' WHEN 1 THEN 'open' WHEN 2 THEN 'search' WHEN 3 THEN 'youtube-search' WHEN 4 THEN 'media' WHEN 8 THEN 'search' END AS via FROM part""")
def f02_match_fast_path(spark, sf_dir):
    m = _said(spark, sf_dir).select("p_partkey", c.match_fast_path(F.col("text")).alias("m"))
    return m.select("p_partkey", "m.tool", F.col("m.args")["query"].alias("query"), F.col("m.args")["target"].alias("target"), F.col("m.args")["service"].alias("service"), "m.via")


_ENC = "replace(replace(replace(p_name || ' é(' || p_partkey || ')~!', ' ', '%20'), 'é', '%C3%A9'), '/', '%2F')"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'spotify:search:' || {_ENC} WHEN 1 THEN 'https://www.youtube.com/results?search_query=' || {_ENC} WHEN 2 THEN 'https://music.apple.com/search?term=' || {_ENC} END AS link, 'https://www.google.com/search?q=' || {_ENC} AS url FROM part")
def f03_media_link(spark, sf_dir):
    q = F.concat("p_name", F.lit(" é("), _k().cast("string"), F.lit(")~!"))
    service = F.element_at(F.array(F.lit("Spotify"), F.lit("YouTube"), F.lit("Apple Music"), F.lit("Radio")), (_k() % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", c.media_link(service, q).alias("link"), c.search_url(q).alias("url"))


_GOALS = ["buy {}", "send 20 dollars to {}", "type the password for {}", "log into {}", "delete the whole {} folder", "message {} about it", "share {}", "send {} the note", "show {} again"]
_RISK = ["refuse", "refuse", "refuse", "refuse", "refuse", "confirm", "confirm", "confirm", "auto"]
_CLICKS = ["Password for {}", "Add to cart {}", "Reply to {}", "Remove {}", "See {}"]


def _templates(items):
    return F.element_at(F.array(*(F.concat(F.lit(x.split("{}")[0]), F.col("p_name"), F.lit(x.split("{}")[1])) for x in items)), (_k() % len(items) + 1).cast("int"))


def _pick(items, n=None):
    return f"list_extract([{', '.join(repr(x) if x is not None else 'NULL' for x in items)}], (p_partkey % {n or len(items)} + 1)::INT)"


@query(f"SELECT p_partkey, {_pick(_RISK)} AS level, {_pick([c.GOAL_RULES[i][2] if i < 8 else None for i in range(9)])} AS reason FROM part")
def f04_assess_goal(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.assess_goal(_templates(_GOALS)).alias("r")).select("p_partkey", "r.*")


@query(f"SELECT p_partkey, {_pick(['refuse', 'confirm', 'confirm', 'confirm', 'auto'])} AS level, {_pick([r[2] for r in c.CLICK_RULES] + [None])} AS reason FROM part")
def f05_assess_click(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.assess_click(_templates(_CLICKS)).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'confirm' ELSE 'auto' END AS level, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'This would run an executable file' END AS reason FROM part")
def f06_risk_of_opening(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.risk_of_opening(_templates(["{}.EXE ", "{}.com", " https://{}.com", "{}.txt"])).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'refuse' WHEN 1 THEN 'confirm' WHEN 2 THEN 'auto' WHEN 3 THEN 'error' ELSE 'auto' END AS level, CASE p_partkey % 5 WHEN 0 THEN 'Agent mode never spends money' WHEN 1 THEN 'This would run an executable file' WHEN 3 THEN 'unknown tool fly' END AS reason FROM part")
def f07_assess_command(spark, sf_dir):
    k = _k() % 5
    tool = F.when(k == 0, "computer_task").when(k == 1, "open_target").when(k == 2, "search_web").when(k == 3, "fly").otherwise("open_target")
    args = F.when(k == 0, F.create_map(F.lit("goal"), F.concat(F.lit("buy "), "p_name"))).when(k == 1, F.create_map(F.lit("target"), F.lit("x.exe"))).otherwise(F.create_map(F.lit("target"), F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", c.assess_command(tool, args).alias("r")).select("p_partkey", "r.*")


def recipes(spark, sf_dir):
    from ..sources.files import RECIPES

    b = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("n", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long"))
    text = F.to_json(F.struct(F.col("p_brand").alias("id"), F.array(F.concat(F.lit("open {what} in "), F.lower("p_brand")), F.concat(F.lower("p_brand"), F.lit(" find {what} near {place}"))).alias("patterns"), F.array(F.lit("what")).alias("slots"), F.lit("builtin").alias("source"),
                              F.array(F.struct(F.lit("launch").alias("action"), F.col("p_brand").alias("app"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("type").alias("action"), F.lit(None).cast("string").alias("app"), F.when(F.col("n") % 2 == 0, "{{what}} to me@mail.org").otherwise("{{what}}").alias("text"))).alias("steps"),
                              F.struct((F.col("n") % 5 == 0).alias("quarantined")).alias("stats")))
    return b.select(F.from_json(text, RECIPES).alias("r")).select("r.*")


_U = "(SELECT p_partkey AS k, p_name AS n, p_brand AS b, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT % 5 = 0 AS q FROM part)"


@query(f"SELECT k AS p_partkey, b AS recipe_id, n AS what, CASE WHEN k % 4 = 1 THEN 'here' END AS place FROM {_U} WHERE NOT q AND k % 4 <> 2")
def f08_match_recipes(spark, sf_dir):
    low = F.lower("p_brand")
    k = _k() % 4
    said = F.when(k == 0, F.concat(F.lit("Open "), "p_name", F.lit(" in "), low, F.lit("."))).when(k == 1, F.concat("p_brand", F.lit(" find  "), "p_name", F.lit(" near here"))).when(k == 2, F.concat(F.lit("close "), "p_name")).otherwise(F.concat("p_name", F.lit(" inside "), "p_brand", F.lit("!")))
    # a pattern that starts with a slot, too
    known = recipes(spark, sf_dir).withColumn("patterns", F.array_append("patterns", F.concat(F.lit("{what} inside "), F.lower("id"))))
    m = c.match_recipes(table(spark, sf_dir, "part").select("p_partkey", said.alias("text")), known, key="p_partkey")
    return m.select("p_partkey", "recipe_id", F.element_at(F.col("slots"), F.lit("what")).alias("what"), F.element_at(F.col("slots"), F.lit("place")).alias("place"))


@query(f"SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN 'open-2' WHEN 1 THEN b ELSE 'wide-1' END AS recipe_id, CASE k % 3 WHEN 2 THEN 'X' || split_part(n, ' ', 1) ELSE n END AS what FROM {_U}")
def f08_open_recipes(spark, sf_dir):
    """Fifteen hundred patterns without a word of their own beside those with words; a pattern's rarest word leads to it."""
    p = spread(table(spark, sf_dir, "part"))
    k = _k() % 3
    said = F.when(k == 0, F.concat(F.lit("please open "), "p_name", F.lit(" now"))).when(k == 1, F.concat(F.lit("please open "), "p_name", F.lit(" in "), F.lower("p_brand"))).otherwise(F.concat(F.lit("X"), "p_name", F.lit(" tail.")))
    one = lambda i, pattern: F.struct(i.alias("id"), F.array(pattern).alias("patterns"), F.array(F.lit("what")).alias("slots"), F.struct(F.lit(False).alias("quarantined")).alias("stats"))
    own = p.select("p_brand").distinct().select(one(F.col("p_brand"), F.concat(F.lit("please open {what} in "), F.lower("p_brand"))).alias("r")).select("r.*")
    open_ = spark.range(3).select(one(F.concat(F.lit("open-"), "id"), F.when(F.col("id") == 2, "please open {what} now").when(F.col("id") == 1, "{what}now").otherwise("{what}")).alias("r")).select("r.*")
    # glued to a slot there is no word, so all of these are asked of every text; those of one shape once
    wide = spark.range(1500).select(one(F.concat(F.lit("wide-"), "id"), F.when(F.col("id") == 1499, "{what}.").when(F.col("id") % 2 == 0, F.concat(F.lit("q"), "id", F.lit("{what}"))).otherwise("{what} {else}")).alias("r")).select("r.*")
    m = c.match_recipes(p.select("p_partkey", said.alias("text")), own.unionByName(open_).unionByName(wide), key="p_partkey")
    return m.select("p_partkey", "recipe_id", F.element_at(F.col("slots"), F.lit("what")).alias("what"))


@query("SELECT p_partkey, 'say ' || p_name || ' to ' || p_brand || '  end' AS text FROM part")
def f09_interpolate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.interpolate(F.lit("say {{a}} to {{b}} {{nobody}} end"), F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_brand"))).alias("text"))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'own ' END || p_partkey AS id, 'learned' AS source FROM part UNION ALL SELECT p_partkey::VARCHAR, 'builtin' FROM part WHERE p_partkey % 3 <> 0")
def f10_resolve_recipe_set(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _k().cast("string").alias("id"))
    own = F.concat(F.when(_k() % 3 == 0, "").otherwise("own "), "id")
    return c.resolve_recipe_set(p.select("id", F.lit("builtin").alias("source")), p.select(own.alias("id"), F.lit("learned").alias("source")))


@query(r"""SELECT doc_id, line, r IS NULL AS ok, r AS reason FROM (SELECT doc_id, line, CASE WHEN v = '' THEN NULL WHEN regexp_matches(v, '(?i)[A-Za-z]:\\Users\\[^\\/*?"<>|]+') OR regexp_matches(v, '/(?:home|Users)/[^/\s]+') THEN 'contains a user profile path' WHEN regexp_matches(v, '[\w.+-]+@[\w-]+\.[\w.]+') THEN 'contains an email address'
WHEN regexp_matches(v, '\+?\d[\d\s().-]{7,}\d') THEN 'contains a phone number' WHEN regexp_matches(v, '\b(?:\d[ -]*){13,16}\b') THEN 'contains a card-like number' WHEN regexp_matches(v, '(?i)\b(?:password|passcode|api[_\s-]?key|secret|token)\b') THEN 'contains a credential' WHEN length(v) > 60 THEN 'is long free text (looks like user content, not a UI label)' END AS r
FROM (SELECT doc_id, unnest(range(len(l)))::INTEGER AS line, trim(unnest(l), ' ') AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def f11_check_literal(spark, sf_dir):
    """Every line of every text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", c.check_literal(F.col("t")).alias("v")).select("doc_id", "line", "v.*")


@query("SELECT DISTINCT p_brand AS id FROM part WHERE regexp_extract(p_brand, '(\\d+)', 1)::BIGINT % 2 = 1")
def f12_shareable_recipes(spark, sf_dir):
    return c.shareable_recipes(recipes(spark, sf_dir)).select("id")


@query("SELECT DISTINCT p_brand AS id, 'step \"type\" contains an email address' AS reason FROM part WHERE regexp_extract(p_brand, '(\\d+)', 1)::BIGINT % 2 = 0")
def f12_refused_recipes(spark, sf_dir):
    return c.refused_recipes(recipes(spark, sf_dir))


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS ok FROM part")
def f13_typed_text_ok(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.typed_text_ok(F.when(_k() % 3 == 0, "{{a}} {{b}}").when(_k() % 3 == 1, "my password").otherwise("hello")).alias("ok"))


@query("""SELECT p_partkey AS run_id, p_partkey % 4 < 2 AS ok, CASE p_partkey % 4 WHEN 2 THEN 'a click had no label to match on later' WHEN 3 THEN 'typed text contains a credential' END AS reason, CASE p_partkey % 4 WHEN 0 THEN 'message {text}' WHEN 1 THEN 'press {target} now' END AS pattern FROM part""")
def f14_record_recipes(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), _k() % 4
    runs = p.select(_k().alias("run_id"), F.when(k == 0, F.concat(F.lit("message "), "p_name")).when(k == 1, F.concat(F.lit("press "), "p_name", F.lit(" now."))).otherwise("go on").alias("utterance"))
    a = p.select(_k().alias("run_id"), F.lit(1).alias("pos"), F.when(k == 0, "type").when(k < 3, "click").otherwise("type").alias("kind"), F.lit(None).cast("string").alias("app"), F.when(k == 1, F.upper("p_name")).when(k == 0, "Message box").alias("label"), F.when(k == 0, F.col("p_name")).when(k == 3, "my secret").alias("text"), F.lit(None).cast("array<string>").alias("keys"))
    launch = p.select(_k().alias("run_id"), F.lit(0).alias("pos"), F.lit("launch").alias("kind"), F.lit("mail").alias("app"), *(F.lit(None).cast(t).alias(x) for x, t in (("label", "string"), ("text", "string"), ("keys", "array<string>"))))
    return c.record_recipes(a.unionAll(launch), runs).select("run_id", "ok", "reason", "pattern")


@query("""WITH o AS (SELECT o_custkey AS recipe_id, o_orderkey AS seq, o_orderkey % 3 = 0 AS ok FROM orders), l AS (SELECT recipe_id, count(*) FILTER (ok) AS successes, max(seq) FILTER (ok) AS last FROM o GROUP BY 1)
SELECT l.recipe_id, successes, count(seq) AS failures, count(seq) >= 3 AS quarantined FROM l LEFT JOIN o ON o.recipe_id = l.recipe_id AND NOT o.ok AND (last IS NULL OR seq > last) GROUP BY 1, 2""")
def f15_recipe_stats(spark, sf_dir):
    return c.recipe_stats(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recipe_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 == 0).alias("ok")))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS ok FROM part")
def f16_label_matches(spark, sf_dir):
    wanted = F.when(_k() % 3 == 0, F.concat(F.col("p_name"), F.lit("x"))).otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", c.label_matches(F.concat(F.lit("The: "), "p_name", F.lit("!")), wanted).alias("ok"))


def _screens(spark, sf_dir):
    """Orders as snapshots, their lines as elements."""
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    l = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])  # noqa: E741
    return l.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("pos"), i.alias("id"), F.when(F.col("l_linenumber") % 3 == 0, "Play").when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Song "), (F.col("l_linenumber") % 2).cast("string"))).otherwise("Box").alias("name"),
                    F.when(F.col("l_linenumber") % 2 == 0, "Button").otherwise("Edit").alias("type"), (F.col("l_linenumber") % 3 == 0).alias("invoke"), (F.col("l_linenumber") % 2 == 1).alias("value"))


_EL = "(SELECT DISTINCT l_orderkey AS s, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'Play' WHEN 1 THEN 'Song ' || (l_linenumber % 2) ELSE 'Box' END AS name FROM lineitem)"


@query(f"SELECT s AS selector_id, CASE WHEN count(*) FILTER (name = 'Song 1') = 1 THEN max(id) FILTER (name = 'Song 1') END AS element_id, CASE WHEN count(*) FILTER (name = 'Song 1') > 1 THEN '\"song 1\" matches ' || count(*) FILTER (name = 'Song 1') || ' controls' WHEN count(*) FILTER (name = 'Song 1') = 0 THEN 'no control matching \"song 1\"' END AS reason FROM {_EL} GROUP BY s")
def f17_resolve_selectors(spark, sf_dir):
    e = _screens(spark, sf_dir)
    s = e.select("snapshot_id").distinct().select(F.col("snapshot_id").alias("selector_id"), "snapshot_id", F.lit("song 1").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("invokable"), F.lit(False).alias("editable"))
    return c.resolve_selectors(s, e)


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS ok FROM part")
def f18_title_matches(spark, sf_dir):
    w = F.split("p_name", " ")
    q = F.when(_k() % 3 == 0, F.upper("p_name")).when(_k() % 3 == 1, F.concat_ws(" ", F.get(w, F.lit(0)), F.element_at(w, -1))).otherwise(F.concat("p_name", F.lit(" zz")))
    return table(spark, sf_dir, "part").select("p_partkey", c.title_matches(F.concat(F.lit("My "), "p_name", F.lit(" (live)")), q).alias("ok"))


@query(f"WITH e AS (SELECT * FROM {_EL}), m AS (SELECT s, min(n) FILTER (name = 'Song 1') AS m FROM e GROUP BY s) SELECT m.s AS snapshot_id, min(id) AS element_id FROM m LEFT JOIN e ON e.s = m.s AND name = 'Play' AND n > m AND n <= m + 12 GROUP BY m.s")
def f19_find_play_button(spark, sf_dir):
    e = _screens(spark, sf_dir)
    return c.find_play_button(e, e.select("snapshot_id").distinct().withColumn("query", F.lit("song 1")))


@query(r"""WITH n AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS n FROM part), q AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN 'task manager' ELSE CASE WHEN p_partkey % 4 = 2 THEN substr(p_name, (2 + p_partkey % 5)::INT, (1 + p_partkey % 7)::INT) ELSE p_name[1:(4 + p_partkey % 9)::INT] END END AS query FROM part WHERE p_partkey < 400),
h AS (SELECT k, name, CASE WHEN n.n = x THEN 0 WHEN starts_with(n.n, x) THEN 1 ELSE 2 END AS tier FROM (SELECT k, query, regexp_replace(lower(query), '[^a-z0-9]', '', 'g') AS x FROM q WHERE query <> 'task manager') z JOIN n ON x <> '' AND contains(n.n, x)),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, length(name), name) AS r FROM h)
SELECT q.k AS query_id, CASE WHEN query = 'task manager' THEN 'taskmgr' ELSE name END AS match, CASE WHEN query = 'task manager' THEN 'alias' ELSE list_extract(['exact', 'prefix', 'contains'], tier + 1) END AS tier FROM q LEFT JOIN b ON b.k = q.k AND r = 1""".replace(" WHERE p_partkey < 400", ""))
def f20_match_app_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.select(_k().alias("query_id"), F.when(_k() % 4 == 3, "task manager").when(_k() % 4 == 2, F.substring(F.col("p_name"), (2 + _k() % 5).cast("int"), (1 + _k() % 7).cast("int"))).otherwise(F.substring(F.col("p_name"), F.lit(1), (4 + _k() % 9).cast("int"))).alias("query"))
    return c.match_app_names(q, p.select(F.col("p_name").alias("name")).distinct())


@query("SELECT event_id, coalesce(a = lag(a) OVER w AND a = lag(a, 2) OVER w, false) AS looping FROM (SELECT event_id, user_id, event_type || (event_id % 2) AS a FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def f21_action_loops(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tool"), F.create_map(F.lit("x"), (F.col("event_id") % 2).cast("string")).alias("args"))
    return c.action_loops(e).select("event_id", "looping")


@query("""SELECT s AS snapshot_id, string_agg('[' || id || '] "' || name || '" (' || CASE WHEN n % 2 = 1 THEN 'input' ELSE 'button' END || ')', chr(10) ORDER BY n) FILTER (n <= 3 AND r <= 3) || CASE WHEN max(r) > 3 THEN chr(10) || '…and ' || (max(r) - 3) || ' more (scroll to reveal)' ELSE '' END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n) AS r FROM EL) GROUP BY s""".replace("EL)", _EL + ")").replace("n <= 3 AND ", ""))
def f22_format_elements(spark, sf_dir):
    return c.format_elements(_screens(spark, sf_dir), most=3)


_ST = "list_extract(['done','clarify','cancelled','refused','error','confirm','done'], (event_id % 7 + 1)::INT)"


@query(f"""WITH e AS (SELECT user_id AS r, event_id AS ts, user_id % 7 AS day, {_ST} AS stage, list_extract(['recipe','fast','router'], (user_id % 3 + 1)::INT) AS via FROM events),
l AS (SELECT r, arg_max(stage, ts) AS stage, max(day) AS day, max((stage = 'confirm')::INT) AS proposed, max(via) AS via FROM e GROUP BY r)
SELECT day, {', '.join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in c.STAGES)}, round(coalesce(sum(proposed) FILTER (stage = 'done'), 0) / sum(proposed)::DOUBLE, 4) AS approval, {', '.join(f"count(*) FILTER (via = '{v}') AS via_{v}" for v in ('recipe', 'fast', 'router'))} FROM l GROUP BY day""")
def f23_command_funnel(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    stage = F.element_at(F.array(*map(F.lit, ["done", "clarify", "cancelled", "refused", "error", "confirm", "done"])), (i % 7 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(u.alias("run_id"), i.alias("ts"), (u % 7).alias("day"), stage.alias("stage"), F.element_at(F.array(F.lit("recipe"), F.lit("fast"), F.lit("router")), (u % 3 + 1).cast("int")).alias("via"))
    return c.command_funnel(e)
