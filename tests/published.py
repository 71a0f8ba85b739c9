"""Published triangles, as rows of cumulative amounts."""

# Published triangles.
TAYLOR_ASHE = [
    [357848, 1124788, 1735330, 2218270, 2745596, 3319994, 3466336, 3606286, 3833515, 3901463],
    [352118, 1236139, 2170033, 3353322, 3799067, 4120063, 4647867, 4914039, 5339085],
    [290507, 1292306, 2218525, 3235179, 3985995, 4132918, 4628910, 4909315],
    [310608, 1418858, 2195047, 3757447, 4029929, 4381982, 4588268],
    [443160, 1136350, 2128333, 2897821, 3402672, 3873311],
    [396132, 1333217, 2180715, 2985752, 3691712],
    [440832, 1288463, 2419861, 3483130],
    [359480, 1421128, 2864498],
    [376686, 1363294],
    [344014],
]
RAA = [
    [5012, 8269, 10907, 11805, 13539, 16181, 18009, 18608, 18662, 18834],
    [106, 4285, 5396, 10666, 13782, 15599, 15496, 16169, 16704],
    [3410, 8992, 13873, 16141, 18735, 22214, 22863, 23466],
    [5655, 11555, 15766, 21266, 23425, 26083, 27067],
    [1092, 9565, 15836, 22169, 25955, 26180],
    [1513, 6445, 11702, 12935, 15852],
    [557, 4020, 10946, 12314],
    [1351, 6947, 13112],
    [3133, 5395],
    [2063],
]


def cells(spark, *triangles, kind="paid", first=1):
    """Cells of several triangles, a segment each (s0, s1, ...)."""
    rows = []
    for s, tri in enumerate(triangles):
        width = max(map(len, tri))
        for i, row in enumerate(tri):
            for j in range(width):
                rows.append((f"s{s}", kind, str(2000 + first + i), i, 12 * (j + 1), j, float(row[j]) if j < len(row) and row[j] is not None else None))
    return spark.createDataFrame(rows, "segment string, kind string, origin string, origin_idx int, age int, age_idx int, value double")
