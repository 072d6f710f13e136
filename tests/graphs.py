"""Small graphs with known results."""

from arcweave.plans.graph import PropertyGraph

# fixed values: the persons, places and films of the golden queries, ids in this order
PERSONS = [("Rachel Kempson", 1910), ("Michael Redgrave", 1908), ("Vanessa Redgrave", 1937), ("Corin Redgrave", 1939), ("Liam Neeson", 1952), ("Natasha Richardson", 1963), ("Richard Harris", 1930), ("Dennis Quaid", 1954), ("Lindsay Lohan", 1986), ("Jemma Redgrave", 1965), ("Roy Redgrave", 1873), ("John Williams", 1932), ("Christopher Nolan", 1970)]
CITIES = ["New York", "London", "Houston"]
FILMS = ["Goodbye, Mr. Chips", "Batman Begins", "Harry Potter and the Sorcerer's Stone", "The Parent Trap", "Camelot"]
HAS_CHILD = [(0, 2), (0, 3), (1, 2), (1, 3), (3, 9), (2, 5), (10, 1)]
MARRIED = [(0, 1), (1, 0), (5, 4), (4, 5)]
BORN_IN = [(2, 14, "2023-05-01 10:00:00", 20.21), (5, 14, "2023-05-01 11:00:00", 20.18), (12, 14, "2023-05-01 12:00:00", 19.93), (7, 15, "2023-05-01 13:00:00", 19.11), (8, 13, "2023-05-01 14:00:00", 20.62), (11, 13, "2023-05-01 15:00:00", 20.55)]
DIRECTED = [(12, 17)]
WROTE_MUSIC_FOR = [(11, 18), (11, 16)]
ACTED_IN = [(1, 16, "The Headmaster"), (2, 20, "Guenevere"), (6, 20, "King Arthur"), (6, 18, "Albus Dumbledore"), (5, 19, "Liz James"), (7, 19, "Nick Parker"), (8, 19, "Halle/Annie"), (4, 17, "Henri Ducard")]


def movies(spark) -> PropertyGraph:
    make = spark.createDataFrame
    g = PropertyGraph(spark)
    g = g.with_vertices("Person", make([(i, n, y) for i, (n, y) in enumerate(PERSONS)], "_id long, name string, birthyear short"), "name")
    g = g.with_vertices("City", make([(13 + i, n) for i, n in enumerate(CITIES)], "_id long, name string"), "name")
    g = g.with_vertices("Film", make([(16 + i, n) for i, n in enumerate(FILMS)], "_id long, title string"), "title")
    plain = lambda rows: make([(k, *r) for k, r in enumerate(rows)], "_eid long, _src long, _dst long")
    g = g.with_edges("HAS_CHILD", "Person", "Person", plain(HAS_CHILD)).with_edges("MARRIED", "Person", "Person", plain(MARRIED))
    born = make([(k, *r) for k, r in enumerate(BORN_IN)], "_eid long, _src long, _dst long, t string, weight double").selectExpr("_eid", "_src", "_dst", "cast(t as timestamp_ntz) as reg_time", "cast(weight as float) as weight")
    g = g.with_edges("BORN_IN", "Person", "City", born).with_edges("DIRECTED", "Person", "Film", plain(DIRECTED)).with_edges("WROTE_MUSIC_FOR", "Person", "Film", plain(WROTE_MUSIC_FOR))
    return g.with_edges("ACTED_IN", "Person", "Film", make([(k, *r) for k, r in enumerate(ACTED_IN)], "_eid long, _src long, _dst long, charactername string"))
