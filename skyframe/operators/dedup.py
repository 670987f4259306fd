"""De-duplication of a catalog across overlapping bricks.

The published rule is greedy along right ascension: a row that is already gone suppresses nothing,
and a row that loses ends its own scan.  What a row does depends on rows before it within two
tolerances alone, so the scan runs by tiles of ``TILE`` tolerances, which see a halo of rows around.

A tile first guesses what the rows of its halo do by scanning them too.  Where the guess differs from
what their own tile found, the tile scans again with their outcomes as given, until nothing changes.
As every row depends only on rows before it, there is one such state, that of the whole scan.  No pair
is stored, so crowded fields, where all rows form one component, cost what sparse ones do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DedupConfig
from ..plans.durable import cut
from . import unions
from .unions import roots

TILE, HALO = 64, 6  # in tolerances
REACH, EDGE = 2.02, 2.03  # tolerances within which rows bear on a row; and from the edge of a tile, within which they may bear on rows of another
CHUNK = 1 << 16  # rows of small tiles that are scanned together
LAP = 1.000001  # slack for rounding in zones and windows; the exact tests follow


def sides(cat: DataFrame, cfg: DedupConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of pairs, with ``zone, slice`` to join by; the first has a row once for each place it looks into.

    Zones in declination are two tolerances high, slices of right ascension twice the widest window of
    rows that look into the zone, so that a row has few places and meets few others there.
    """
    tol = cfg.tolerance_arcsec / 3600.0
    height, near = 2 * tol * LAP, tol * LAP
    c = positioned(cat, cfg)
    far = F.greatest(F.abs(F.col("zone") - 1), F.abs(F.col("zone") + 2)) * height  # beyond every row that looks into the zone
    width = F.lit(height) / F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(cfg.min_cos_dec))
    i, j = (c.select(*[F.col(x).alias(f"{x}_{k}") for x in ("id", "brick", "ra", "dec", "npix", "cosd")]) for k in "ij")
    zones = f"sequence(cast(floor((dec_i - {near!r}D) / {height!r}D) as long), cast(floor((dec_i + {near!r}D) / {height!r}D) as long))"
    slices = f"sequence(cast(floor(ra_i / width) as long), cast(floor((ra_i + {near!r}D / cosd_i) / width) as long))"
    left = i.withColumn("zone", F.explode(F.expr(zones))).withColumn("width", width).withColumn("slice", F.explode(F.expr(slices))).drop("width")
    right = j.withColumn("zone", F.floor(F.col("dec_j") / height).cast("long")).withColumn("slice", F.floor(F.col("ra_j") / width).cast("long"))
    return left, right


def candidate_pairs(cat: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Pairs ``i, j`` (in right-ascension order) within the tolerance, by an equi-join.

    ``cat`` needs ``id, brick, ra, dec, npix``; ``id`` is the tie order.
    """
    left, right = sides(cat, cfg)
    p = left.join(right, ["zone", "slice"]).where("(ra_i < ra_j or (ra_i = ra_j and id_i < id_j))")
    if not cfg.same_brick:
        p = p.where("brick_i <> brick_j")
    d = F.expr("ra_j - ra_i")
    p = p.where(d <= F.lit(cfg.tolerance_arcsec / 3600.0) / F.col("cosd_i"))
    sep = F.sqrt((d * F.col("cosd_i")) * (d * F.col("cosd_i")) + F.expr("(dec_j - dec_i) * (dec_j - dec_i)")) * 3600.0
    return p.withColumn("sep", sep).where(F.col("sep") < cfg.tolerance_arcsec).select("id_i", "id_j", "ra_i", "ra_j", "dec_i", "dec_j", "cosd_i", "cosd_j", "npix_i", "npix_j", "sep")


def positioned(cat: DataFrame, cfg: DedupConfig) -> DataFrame:
    """``id, brick, ra, dec, npix, cosd`` of the rows that have a finite position; others have no pair."""
    c = cat.where("abs(ra) < double('infinity') and abs(dec) < double('infinity')").select("id", "brick", F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), F.col("npix").cast("int").alias("npix"))
    return c.withColumn("cosd", F.greatest(F.abs(F.cos(F.radians("dec"))), F.lit(cfg.min_cos_dec)))


def dealt(rows: DataFrame, cfg: DedupConfig, halo: float) -> DataFrame:
    """``rows`` at every tile ``band, slot`` that sees them: ``home`` in one, within ``halo`` tolerances of others.

    Slots of a band are as wide as its poleward edge asks for.  A tile looks ahead by one window only: rows
    there are met, but what they do comes later.
    """
    tol = cfg.tolerance_arcsec / 3600.0
    size, high = TILE * tol, halo * tol
    bands = rows.withColumn("band", F.explode(F.expr(f"sequence(cast(floor((dec - {high!r}D) / {size!r}D) as long), cast(floor((dec + {high!r}D) / {size!r}D) as long))")))
    reach = HALO * tol
    far = F.greatest(F.abs(F.col("band") * size - reach), F.abs((F.col("band") + 1) * size + reach))
    wide = bands.withColumn("width", F.lit(size) / F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(cfg.min_cos_dec)))
    slots = wide.withColumn("slot", F.explode(F.expr(f"sequence(cast(floor(ra / width - {1.01 / TILE!r}D) as long), cast(floor(ra / width + {halo / TILE!r}D) as long))")))
    return slots.withColumn("home", F.expr(f"floor(dec / {size!r}D) = band and floor(ra / width) = slot"))


def whole_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in tile order, joined so that none ends within a tile."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) < CHUNK:
            continue
        last = (b.band.iloc[-1], b["slot"].iloc[-1])
        if (held[0].band.iloc[0], held[0]["slot"].iloc[0]) == last:
            continue
        rows = pd.concat(held, ignore_index=True)
        end = ((rows.band == last[0]) & (rows["slot"] == last[1])).to_numpy()
        yield rows[~end].reset_index(drop=True)
        held = [rows[end]]
    if held:
        yield pd.concat(held, ignore_index=True)


class Field:
    """Rows of whole tiles in scan order, and which of them are within the tolerance of one another."""

    def __init__(self, t: pd.DataFrame, cfg: DedupConfig):
        self.cfg, self.tol, self.m = cfg, cfg.tolerance_arcsec / 3600.0, len(t)
        self.ra, self.dec, self.cosd = (t[k].to_numpy(float) for k in ("ra", "dec", "cosd"))
        self.brick = pd.factorize(t.brick)[0]
        band, slot, width = t.band.to_numpy(np.int64), t["slot"].to_numpy(np.int64), t.width.to_numpy(float)
        tile = np.r_[0, np.cumsum((np.diff(band) != 0) | (np.diff(slot) != 0))] if self.m else np.zeros(0, np.int64)
        zones = TILE + 2 * HALO + 8
        zone = np.floor(self.dec / (self.tol * LAP)).astype(np.int64) - np.floor(band * (TILE / LAP)).astype(np.int64) + HALO + 3
        self.group = tile * zones + zone
        self.by_zone = np.argsort(self.group, kind="stable")
        self.keys = self.group[self.by_zone] * self.m + self.by_zone
        along = 4.0 * tile + (self.ra / width - slot)
        self.until = np.searchsorted(along, along + self.tol / self.cosd / width * LAP + 1e-8, "right")
        self.step = max(512, int(np.bincount(tile).max(initial=0)) // (4 * TILE))  # rows of about a quarter of a tolerance, where they are dense

    def near(self, i: np.ndarray, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of ``i`` (ascending) with later rows, in scan order."""
        out_i, out_j = [], []
        for o in (-1, 0, 1):
            base = (self.group[i] + o) * self.m
            lo, hi = np.searchsorted(self.keys, base + i + 1), np.searchsorted(self.keys, base + self.until[i])
            n = np.maximum(hi - lo, 0)
            a = np.repeat(i, n)
            b = self.by_zone[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
            ok = np.ones(len(a), bool) if usable is None else usable[b]
            if not self.cfg.same_brick:
                ok &= (self.brick[a] != self.brick[b]) & (self.brick[a] >= 0) & (self.brick[b] >= 0)
            a, b = a[ok], b[ok]
            d, h, c = self.ra[b] - self.ra[a], self.dec[b] - self.dec[a], self.cosd[a]
            ok = (d <= self.tol / c) & (np.sqrt((d * c) * (d * c) + h * h) * 3600.0 < self.cfg.tolerance_arcsec)
            out_i.append(a[ok])
            out_j.append(b[ok])
        a, b = np.concatenate(out_i), np.concatenate(out_j)
        order = np.lexsort((b, a))
        return a[order], b[order]


def scan(t: pd.DataFrame, cfg: DedupConfig) -> pd.DataFrame:
    """``t`` with ``stop_ra, stop_id`` of its rows: before which row each one's scan ends.

    ``-inf`` is that of a row that was gone before its turn, ``inf`` that of one that stays.  Rows that are not at
    home and have a stop already do what it says.
    """
    f, ids, npix = Field(t, cfg), t.id.tolist(), t.npix.to_numpy(float).tolist()
    ra, stop, stop_id = f.ra.tolist(), t.stop_ra.to_numpy(float).copy(), t.stop_id.tolist()
    given = ~t.home.to_numpy(bool) & ~np.isnan(stop)
    stop[~given] = np.inf
    for k in np.flatnonzero(~given).tolist():
        stop_id[k] = ids[k]
    held, idle = bytearray(f.m), given & (stop == -np.inf)
    gone = np.frombuffer(held, dtype=bool)
    for s in range(0, f.m, f.step):
        e = min(s + f.step, f.m)
        a, b = f.near(s + np.flatnonzero(~np.where(given[s:e], idle[s:e], gone[s:e])), gone == 0)
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
        js, bounds = b.tolist(), [*map(int, cuts), len(a)]
        for i, lo, hi in zip(a[cuts].tolist() if len(a) else [], bounds, bounds[1:]):
            n = npix[i]
            if given[i]:
                end = (stop[i], stop_id[i])
                for j in js[lo:hi]:
                    if (ra[j], ids[j]) >= end:
                        break
                    if n >= npix[j]:
                        held[j] = 1
            elif not held[i]:
                for j in js[lo:hi]:
                    if held[j]:
                        continue
                    if n >= npix[j]:
                        held[j] = 1
                    else:
                        held[i] = 1
                        stop[i], stop_id[i] = ra[j], ids[j]
                        break
        lost = s + np.flatnonzero(gone[s:e] & ~given[s:e] & (stop[s:e] == np.inf))
        stop[lost] = -np.inf
    return t.assign(stop_ra=stop, stop_id=pd.Series(stop_id, index=t.index, dtype=t.id.dtype))


def parts(t: pd.DataFrame, cfg: DedupConfig) -> pd.DataFrame:
    """``t`` with ``root``: least id of each row's component within its tile."""
    f = Field(t, cfg)
    order = np.argsort(t.id.to_numpy(), kind="stable")
    lab, rank = np.arange(f.m), np.argsort(order)
    found = [f.near(np.arange(s, min(s + f.step, f.m))) for s in range(0, f.m, f.step)]
    a, b = (rank[np.concatenate([x[k] for x in found])] if found else np.zeros(0, np.int64) for k in (0, 1))
    while len(a):
        low, high = np.minimum(lab[a], lab[b]), np.maximum(lab[a], lab[b])
        np.minimum.at(lab, high, low)
        while not np.array_equal(lab, lab[lab]):
            lab = lab[lab]
        differ = lab[a] != lab[b]
        a, b = a[differ], b[differ]
    return t.assign(root=pd.Series(t.id.to_numpy()[order][lab[rank]], index=t.index, dtype=t.id.dtype))


def by_tile(tiles: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on whole tiles, whose rows come in scan order."""
    n, names = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in whole_tiles(batches):
            yield work(t)[names]

    return tiles.repartition(n, "band", "slot").sortWithinPartitions("band", "slot", "ra", "id").mapInPandas(run, schema)


def settled(cat: DataFrame, cfg: DedupConfig) -> DataFrame:
    """The positioned rows of ``cat`` with ``stop_ra``, which is finite or -inf for rows that go."""
    kind, tol = dict(cat.dtypes)["id"], cfg.tolerance_arcsec / 3600.0
    columns = f"id {kind}, brick string, ra double, dec double, npix int, cosd double, stop_ra double, stop_id {kind}, band long, slot long"
    names = [c.split()[0] for c in columns.split(", ")]

    def guess(t: pd.DataFrame) -> pd.DataFrame:
        t = scan(t, cfg)
        x, y = (t.ra / t.width - t["slot"]) * TILE, t.dec / tol - t.band * TILE
        near = (x > -REACH) & (t.ra / t.width < t["slot"] + 1) & (y > -REACH) & (y < TILE + REACH)
        inner = (x > EDGE) & (x < TILE - EDGE) & (y > EDGE) & (y < TILE - EDGE)
        return t.assign(edge=~inner)[t.home | near]

    def again(t: pd.DataFrame) -> pd.DataFrame:
        n = scan(t, cfg)
        n["changed"] = t.home & ((n.stop_ra != t.stop_ra) | (n.stop_id != t.stop_id))
        return n[n.home]

    rows = positioned(cat, cfg).withColumn("brick", F.col("brick").cast("string")).withColumns({"stop_ra": F.lit(None).cast("double"), "stop_id": F.col("id")})
    first = cut(by_tile(dealt(rows, cfg, HALO), guess, f"{columns}, home boolean, edge boolean"))
    state = first.where("home").select(names)
    own = first.where("home and edge").select("id", F.col("stop_ra").alias("own_ra"), F.col("stop_id").alias("own_id"))
    stale = cut(first.where("not home").join(own, "id").where("stop_ra <> own_ra or stop_id <> own_id").select("band", "slot").distinct())
    rounds = 0
    while stale.limit(1).count():
        rounds += 1
        tiles = dealt(state.drop("band", "slot"), cfg, REACH).join(stale, ["band", "slot"], "left_semi")
        anew = cut(by_tile(tiles, again, f"{columns}, changed boolean"))
        state = state.join(stale, ["band", "slot"], "left_anti").select(names).unionByName(anew.select(names))
        if rounds % 4 == 0:
            state = cut(state)  # or the plan would grow with every round
        stale = cut(dealt(anew.where("changed").drop("band", "slot"), cfg, REACH).where("not home and ra / width < slot + 1").select("band", "slot").distinct())
    return state


def removed(cat: DataFrame, cfg: DedupConfig) -> DataFrame:
    """``id`` of the rows that go."""
    return settled(cat, cfg).where("stop_ra < double('infinity')").select("id")


def decisions(cat: DataFrame, cfg: DedupConfig) -> DataFrame:
    """``id, root, gone, low, high`` of every row with a position: least id and declination span of its component, and its fate."""
    kind = dict(cat.dtypes)["id"]
    state = cut(settled(cat, cfg))
    tiles = dealt(state.drop("band", "slot"), cfg, REACH)
    seen = cut(by_tile(tiles, lambda t: parts(t, cfg), f"id {kind}, dec double, stop_ra double, home boolean, root {kind}"))
    mine = seen.where("home").drop("home")
    links = seen.where("not home").select("id", F.col("root").alias("a")).join(mine.select("id", F.col("root").alias("b")), "id").where("a <> b").select("a", "b").distinct()
    top = roots(links).select(F.col("id").alias("root"), F.col("root").alias("top"))
    all_ = cut(mine.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"), (F.col("stop_ra") < float("inf")).alias("gone"), "dec"))
    spans = all_.groupBy("root").agg(F.min("dec").alias("low"), F.max("dec").alias("high"))
    return all_.drop("dec").join(spans, "root").select("id", "root", "gone", "low", "high")


def by_position(cat: DataFrame) -> DataFrame:
    """``cat`` in right-ascension order (NULL last), ties by id."""
    return cat.orderBy(F.asc_nulls_last("ra"), "id")


def numbered(cat: DataFrame) -> DataFrame:
    """``cat`` with ``place``, its number in right-ascension order from 1."""
    return unions.numbered(cat, F.asc_nulls_last("ra"), "id")


def deduplicate(cat: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """``cat`` without removed rows, in right-ascension order (NULL last)."""
    return by_position(cat.join(removed(cat, cfg), "id", "left_anti"))
