import random

import numpy as np

from wardenlog.streaming import keyed as K


def test_measures_of_a_key():
    rnd = random.Random(2)
    rows = sorted((rnd.randrange(40) * K.HOUR // 4, f"e{i:03}", 1.0, 2.0, rnd.randint(0, 1), rnd.choice([None, 5, 7]), rnd.randint(0, 1), rnd.choice("abc"), rnd.choice(["x", None]))
                  for i in range(200))
    wanted = np.array(range(120, 200))
    got = K.trailing(rows, wanted, K.ENTITY_SUMS, K.ENTITY_DISTINCT)
    for n, i in enumerate(wanted.tolist()):
        t = rows[i][0]
        for name, c, w in K.ENTITY_SUMS:
            assert got[name][n] == sum(1 if c < 0 else r[c] or 0 for r in rows if t - w <= r[0] < t)
        for name, c, w in K.ENTITY_DISTINCT:
            assert got[name][n] == len({r[c] for r in rows if t - w <= r[0] <= t} - {None})


def test_travel_of_a_key():
    rows = [(0, "a", 0.0, 0.0), (0, "b", 0.0, 1.0), (60_000_000 * 60, "c", 0.0, 2.0), (60_000_000 * 120, "d", None, 2.0)]
    got = K.travelled(rows, np.arange(4))
    assert got["minutes_since_last"] == [-1.0, 0.0, 60.0, 60.0] and got["geo_velocity_kmh"][:2] == [0.0, 0.0]
    assert abs(got["geo_distance_km"][2] - 111.19) < 0.1 and abs(got["geo_velocity_kmh"][2] - 111.19) < 0.1 and got["geo_distance_km"][3] == 0.0
