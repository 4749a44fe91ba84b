"""Prose of languages without a reference, against tables and spam."""

from compare import compare, connect

from palimpsest.llm import quality
from palimpsest.llm.queries import ORACLES, QUERIES

RUSSIAN = """Утром солнце медленно поднималось над широкой рекой, туман уходил в луга, рыбаки уже сидели возле лодок и тихо
говорили о погоде. Старый мельник открыл ворота, выпустил гусей, принес воды из колодца, потом долго смотрел на дорогу,
ведущую к городу. По ней ехала телега с мешками зерна, рядом шагал мальчик лет десяти, держа собаку за веревку. Вечером все
собрались вокруг костра, варили уху, вспоминали прошлое лето, пели песни, пока звезды не погасли над темным лесом."""
FINNISH = """Aamulla aurinko nousi hitaasti leveän joen ylle, sumu väistyi niityiltä, kalastajat istuivat jo veneidensä luona ja
puhuivat hiljaa säästä. Vanha mylläri avasi portin, päästi hanhet ulos, toi vettä kaivosta, katsoi sitten pitkään kaupunkiin
johtavaa tietä. Sitä pitkin kulkivat vankkurit täynnä viljasäkkejä, vieressä asteli kymmenvuotias poika pidellen koiraa
köydestä. Illalla kaikki kokoontuivat nuotion ympärille, keittivät kalakeittoa, muistelivat mennyttä kesää, lauloivat lauluja,
kunnes tähdet sammuivat tumman metsän yllä. Seuraavana päivänä satoi, mutta kukaan heistä ei valittanut."""
HUNGARIAN = """Reggel a nap lassan emelkedett a széles folyó fölé, a köd elvonult a rétekről, a halászok már csónakjaik mellett
ültek, halkan beszélgettek. Az öreg molnár kinyitotta a kaput, kiengedte a libákat, vizet hozott, aztán sokáig nézte a város
felé vezető utat. Szekér jött rajta gabonás zsákokkal, mellette tízéves fiú lépkedett, kötélen vezetve kutyáját. Este mindenki
összegyűlt a tűz körül, halászlét főztek, felidézték a tavalyi nyarat, énekeltek, amíg a csillagok ki nem hunytak a sötét erdő fölött."""


def test_prose_without_a_reference_language_is_kept(spark):
    texts = [RUSSIAN, FINNISH, HUNGARIAN]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = quality.report(docs).collect()
    assert all(r.n_words >= quality.JUDGED_WORDS and r.word_distance > quality.MAX_WORD_DISTANCE for r in rows)
    assert [r.kept for r in sorted(rows)] == [True] * 3


def test_tables_and_spam_still_meet_the_word_distance(spark):
    table = " | ".join(f"{a}{b}rtio" for a in "mnkptsl" for b in ("ano", "eri", "ulo", "ithe", "oda", "ure"))
    spam = " ".join(f"the {a}{b}rtion" for a in "mnkptsl" for b in ("ano", "eri", "ulo", "ithe", "oda", "ure"))
    docs = spark.createDataFrame([(0, table), (1, spam)], "doc_id bigint, text string")
    rows = quality.report(docs).collect()
    assert not any(r.base_failed or r.kept for r in rows)
    assert all(r.char_distance <= quality.MAX_CHAR_DISTANCE for r in rows)


CHINESE = [
    "早晨太阳从宽阔的河面上慢慢升起，雾气退到草地里，渔夫们已经坐在船边轻声谈论天气。",
    "老磨坊主打开大门，放出鹅群，从井里打来水，然后久久望着通向城里的路。",
    "一辆装满粮食口袋的马车沿路驶来，旁边走着一个十岁的男孩，用绳子牵着狗。",
    "傍晚大家围坐在篝火旁煮鱼汤，回忆去年的夏天，唱着歌，直到星星在黑暗的树林上空熄灭。",
    "第二天下起了雨，可是谁也没有抱怨，因为收获已经结束了。",
    "孩子们在谷仓里玩耍，女人们纺线，男人们修理渔网和木船。",
]


def test_scripts_without_spaces_are_kept(spark):
    text = "\n".join(CHINESE * 1 + [line[::-1] for line in CHINESE])
    junk = "\n".join("#@%&*" * 9 + str(k) for k in range(12))
    rows = quality.report(spark.createDataFrame([(0, text), (1, junk)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert rows[0].n_words >= quality.MIN_WORDS and not rows[0].base_failed
    assert [r.kept for r in rows] == [True, False]


def test_sql_follows_the_operator(spark, tmp_path):
    """On prose of unlisted languages, scripts without spaces, tables and spam."""
    table = " | ".join(f"{a}{b}rtio" for a in "mnkptsl" for b in ("ano", "eri", "ulo", "ithe", "oda", "ure"))
    texts = [RUSSIAN, FINNISH, HUNGARIAN, "\n".join(CHINESE * 2), "".join(CHINESE), table, "a b", "", "x " * 80, "the cat of the house and " * 20, "\U0001f600" * 300 + " z" * 12]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    assert compare(QUERIES["op8_quality_rules"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["op8_quality_rules"]) == []
