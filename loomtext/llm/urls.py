"""URL filter: logistic regression on hashed character n-grams of host and path.

The 3- to 5-grams of the host, and those of the rest of the URL, fall into 2^15 slots each; a URL's features
are the shares of its grams in the slots.  The model is trained here, on a small table of labelled URLs, by
gradient descent on the regularised log-loss.  The table is an input of ``judge``; ``labelled`` is the one that comes with this module,
of invented hosts, none of which is a host of the test pages.

Cases: a null URL has a null score and isn't blocked; an empty one has no grams and the model's base rate; URLs of any length are read
whole; case is ignored; rows with a null id are scored too; repeated rows are scored alike; other columns are ignored.  Labelled
rows with a null URL or label don't count; a repeated one counts as often as it stands there; of labels of one kind only, or of none,
every URL gets that share (0 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

SLOT_BITS, SIZES, SCALE, L2, ROUNDS, BLOCK = 15, (3, 4, 5), 12.0, 3e-4, 500, 0.5
#: Labelled rows that are trained on, by a hash of the URL if there are more.
TRAIN_ROWS = 20_000
_GOOD = """news daily-herald city-library weather garden-notes cooking-home museum university research-lab openmaps river-trust schoolhouse
hospital gov-portal archive history-society science-review bookshop bike-repair travel-diary music-school theatre astronomy chess-club photography
knitting python-docs linux-handbook database-guide math-forum parents-council village-hall fire-brigade train-times ferry-lines public-radio
encyclopedia dictionary recipes birdwatch hiking-trails town-council language-course film-archive poetry-corner woodwork open-data health-service
orchestra kindergarten botanic engineering-notes philosophy-today cafe-central bakery mountain-huts sea-charts allotments choir
letters-and-papers farm-market city-archive island-post harbour-news school-library craft-fair cycling-map open-university state-museum
stone-bridge green-valley folk-dance old-maps plant-atlas bird-atlas water-board road-works child-care house-building tax-office post-office
map-room reading-circle family-trees garden-centre winter-sports swim-club chess-problems star-charts rail-history ship-register coin-guide""".split()
_BAD = """buy-pills-online viagra-shop online-casino casino-bonus bets-now sports-bets poker-jackpot win-big-today
adult-video xxx-tube porn-hot hot-singles sexy-cams nude-pics link-farm content-farm ad-tracker click-ads popup-ads
track-pixel payday-loan fast-loan free-money win-prize lottery-win crypto-double weight-loss-pills replica-watches cheap-meds pharma-discount
free-iphone hack-accounts warez-crack keygen-serial torrent-crack escort-girls dating-xxx slots-jackpot bet-bonus loan-cash-now miracle-pills
free-spins-casino adult-chat spam-blast traffic-exchange buy-followers seo-backlinks clickbait-ads malware-download phish-login casino-slots
poker-casino vegas-casino casino-poker live-casino-bets bets-bonus bets-online sports-betting betting-tips jackpot-slots slots-online lotto-jackpot
pills-shop cheap-viagra viagra-cheap pharma-pills meds-online diet-pills weight-loss-fast cheap-replica replica-bags cheap-cigarettes
porn-tube porn-video xxx-porn xxx-cams adult-cams adult-dating sexy-singles hot-girls sexy-girls nude-cams escort-dating hot-dating
payday-cash quick-cash fast-cash-loan loan-now credit-fast bitcoin-double crypto-cash make-money-fast free-cash free-prize prize-winner win-iphone
free-download-crack crack-keygen serial-crack warez-download torrent-free hack-tools password-hack spam-links link-exchange click-traffic
buy-links buy-likes buy-traffic ads-popup popup-click pixel-tracker click-tracker banner-ads ads-network adserver spam-mail bulk-mail""".split()
_PATHS = "/ /about /2019/03/harvest.html /article?id=5 /product/17 /wiki/Lighthouse /search?q=tea /contact.php /gallery/3/ /archive#may".split()
_HEADS, _TAILS = ("www.", "", "m.", "blog."), (".example.com", ".example.org", ".example.net", ".com", ".org")
_BAD_PATHS = ("/free-casino-bonus", "/buy-cheap-pills-online", "/xxx/adult-video", "/win-free-prize?click=ads")


def _names(n: int) -> list[str]:
    """Invented harmless host names: two to four syllables."""
    rng = np.random.Generator(np.random.PCG64(11))
    heads, vowels, ends = "b c d f g h k l m n p r s t v w th sh tr st ch wh br pl".split(), "a e i o u ea ou io".split(), ["", "n", "r", "s", "t", "nd", "th", "ng", "l", "st"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    return ["".join(pick(heads) + pick(vowels) + pick(ends) for _ in range(int(rng.integers(2, 5)))) for _ in range(n)]


def labelled() -> list[tuple[str, int]]:
    """The labelled URL table: (url, 1 if it is to be blocked).  Heads, tails and paths tell nothing of the class."""
    rows = []
    for hosts, bad in ((_GOOD + _names(120), 0), (_BAD * 2, 1)):
        for i, host in enumerate(hosts):
            for k, tail in enumerate(_TAILS):
                rows.append((f"http://{_HEADS[(i + k) % 4]}{host}{tail}{_PATHS[(3 * i + 7 * k) % 10]}", bad))
    return rows + [(f"http://{host}{tail}{path}", 1) for host in _GOOD[:40] for tail, path in zip(_TAILS, _BAD_PATHS)]


def _slots(column: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all grams, owner row of each) of one part of the URLs."""
    raw, off = K.buffers(column)
    h = K.mix(raw.astype(np.uint64) + np.uint64(1000 * salt))
    slots, rows = [], []
    for n in SIZES:
        g = K.grams(h, n)
        ok = K.starts_with_room(off, n)[: len(g)]
        slots.append((g[ok] >> np.uint64(64 - SLOT_BITS)).astype(np.int64) + (salt - 1) * (1 << SLOT_BITS))
        rows.append(K.owners(off)[: len(g)][ok])
    return np.concatenate(slots), np.concatenate(rows)


def _parts(urls: pa.Array) -> list[pa.Array]:
    import pyarrow.compute as pc

    low = pc.utf8_lower(urls.fill_null(""))
    rest = pc.replace_substring_regex(low, r"^[a-z][a-z0-9+.\-]*:", "")
    rest = pc.replace_substring_regex(rest, r"^//([^/?#]*@)?(www\.|m\.|blog\.)?", "")
    host = pc.replace_substring_regex(rest, r"[/?#].*$", "")
    path = pc.replace_substring_regex(rest, r"^[^/?#]*", "")
    return [pc.binary_join_element_wise("^", host, "$", ""), pc.binary_join_element_wise(path, "$", "")]


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """(weights, intercept) learnt from (url, label) rows."""
    y = np.array([bad for _, bad in rows], float)
    if not 0 < y.mean() < 1 if len(y) else True:
        return np.zeros(2 << SLOT_BITS), np.inf if len(y) and y[0] else -np.inf
    slots, owner, value = [], [], []
    for salt, part in enumerate(_parts(pa.array([u for u, _ in rows], pa.string())), 1):
        s, r = _slots(part, salt)
        slots.append(s)
        owner.append(r)
        value.append(SCALE / np.bincount(r, minlength=len(rows))[r])
    owner, value = np.concatenate(owner), np.concatenate(value)
    used, slot = np.unique(np.concatenate(slots), return_inverse=True)
    w, v, bias = np.zeros(len(used)), np.zeros(len(used)), 0.0
    for _ in range(ROUNDS):
        e = (1 / (1 + np.exp(-(np.bincount(owner, value * w[slot], len(y)) + bias))) - y) / len(y)
        v = 0.9 * v - 2.0 * (np.bincount(slot, value * e[owner], len(used)) + L2 * w)
        w += v
        bias -= 0.5 * e.sum()
    full = np.zeros(2 << SLOT_BITS)
    full[used] = w
    return full, float(bias)


@cache
def model() -> tuple[np.ndarray, float]:
    """The model of the table in this module."""
    return fit(labelled())


def score(urls: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(len(urls), bias)
    for salt, part in enumerate(_parts(urls), 1):
        s, r = _slots(part, salt)
        z += SCALE * np.bincount(r, weights[s], len(urls)) / np.maximum(np.bincount(r, minlength=len(urls)), 1)
    return 1 / (1 + np.exp(-z))


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                urls = b.column(1)
                p = score(urls, weights, bias)
                null = ~np.asarray(urls.is_valid())
                yield pa.RecordBatch.from_arrays([b.column(0), urls, pa.array(p, mask=null), pa.array((p >= BLOCK) & ~null)], ["page_id", "url", "spam_score", "blocked"])

    return run


def judge(pages: DataFrame, urls: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, url, spam_score, blocked) of every page.

    ``urls``: (url string, label 0/1), a table of labelled URLs in place of this module's; at most ``train_rows`` of it are used.
    """
    if urls is None:
        found = model()
    else:
        rows = urls.filter("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("int").alias("label"))
        found = fit([tuple(r) for r in rows.orderBy(F.xxhash64("url"), "url", "label").limit(train_rows).collect()])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(_score(*found), "page_id long, url string, spam_score double, blocked boolean")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spam score of every page's URL, and whether it is blocked."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
