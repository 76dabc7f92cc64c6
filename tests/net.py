"""A small hand-made sea network: two ways from WEST to EAST, one port behind a single strait."""

NODES = [
    # node_id, name, kind, lat, lon, country_code, region
    ("AAWES", "West", "port", 0.0, 0.0, "AA", "R1"), ("AAWE2", "West Two", "port", 1.0, 0.0, "AA", "R1"), ("BBEAS", "East", "port", 0.0, 60.0, "BB", "R2"),
    ("CCGUL", "Gulf", "port", 10.0, 50.0, "CC", "R2"), ("CANAL", "Canal", "chokepoint", 0.0, 20.0, None, None), ("STRAIT", "Strait", "chokepoint", 8.0, 52.0, None, None),
    ("NARROW_SEA", "Narrow Sea", "sea_region", 0.0, 40.0, None, None), ("SOUTH_CAPE", "South Cape", "chokepoint", -35.0, 20.0, None, None),
]
LEGS = [("AAWES", "CANAL"), ("AAWE2", "CANAL"), ("CANAL", "NARROW_SEA"), ("NARROW_SEA", "BBEAS"), ("AAWES", "SOUTH_CAPE"), ("SOUTH_CAPE", "BBEAS"),
        ("BBEAS", "STRAIT"), ("NARROW_SEA", "STRAIT"), ("STRAIT", "CCGUL"), ("AAWE2", "SOUTH_CAPE")]
LANES = [("WEST-EAST", "AAWES", "BBEAS", "a_b"), ("WEST2-EAST", "AAWE2", "BBEAS", "a_b"), ("GULF-EAST", "CCGUL", "BBEAS", "c_b"), ("WEST-GULF", "AAWES", "CCGUL", "a_c")]


class Net:
    def __init__(self, spark):
        from laneguard.operators import exposure, network

        self.nodes = spark.createDataFrame(NODES, "node_id string, name string, kind string, lat double, lon double, country_code string, region string")
        self.legs = spark.createDataFrame(LEGS, "from_node string, to_node string")
        self.lanes = spark.createDataFrame(LANES, "lane_id string, origin string, destination string, focus string")
        self.neighbours = network.neighbour_table(self.nodes, self.legs)
        self.routes = network.lane_routes(self.lanes, self.neighbours)
        self.reach = exposure.lane_nodes(self.lanes, self.routes, self.nodes)


def all_paths(lengths, a, b, avoid=()):
    """Every simple path from a to b as (tenths, hops, path), sorted."""
    arcs = {}
    for x, y, t in lengths:
        arcs.setdefault(x, []).append((y, t))
        arcs.setdefault(y, []).append((x, t))
    out, todo = [], [((a,), 0)]
    while todo:
        path, t = todo.pop()
        if path[-1] == b:
            out.append((t, len(path) - 1, path))
            continue
        todo += [((*path, y), t + d) for y, d in arcs.get(path[-1], []) if y not in path and y not in avoid]
    return sorted(out)
