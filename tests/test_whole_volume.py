from collections import defaultdict
from itertools import combinations

from meshlake.plans import catalog

SF = "/root/testdata/sf0.001"


def test_same_label_components_of_the_whole_volume(spark):
    voxel = [(r.x, r.y, r.z, r.label) for r in catalog.voxel_volume(spark, SF).collect()]
    root, sides = {}, defaultdict(list)
    for x, y, z, label in voxel:
        for k, corners in enumerate(catalog.mesh.KUHN):
            tid = (x + catalog.NX * (y + catalog.NY * z)) * 6 + k
            root[tid] = tid
            at = [(x + (c & 1), y + (c >> 1 & 1), z + (c >> 2 & 1)) for c in corners]
            for side in combinations(sorted(at), 3):
                sides[side, label].append(tid)

    def find(t):
        while root[t] != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    for tids in sides.values():
        for t in tids[1:]:
            a, b = find(tids[0]), find(t)
            root[max(a, b)] = min(a, b)
    assert max(x for x, *_ in voxel) > 12
    got = {r.tid: r.component for r in catalog.same_label_components(spark, SF).collect()}
    assert got == {t: find(t) for t in root}
