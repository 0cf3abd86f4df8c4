"""Teams, colours and roles of tracks. In SQL the best groups are found among all partitions of a clip's ten tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmeans, roles, teams
from ..sources import fixtures as fx
from .catalog import query, rounded

WIDTH = 1280.0


def _tracks(s, d):
    """Team A keeps left and team B right, but for clips 6 and 7; track 4 stays before the left goal."""
    x, p, parted = F.col("center_x"), F.col("track_id"), F.col("clip_id") < 6
    t = fx.tracks(s, d).withColumn("center_x", F.when(p == 4, x * 0.125).when(p == 9, x).when(parted & (p < 5), x * 0.5).when(parted, x * 0.5 + 640).otherwise(x))
    return t.withColumns({"x1": F.col("center_x") - 10 - p, "x2": F.col("center_x") + 10 + p, "y1": F.col("center_y") - F.col("height") / 2, "y2": F.col("center_y") + F.col("height") / 2})


def _samples(s, d):
    """Colours of every sighting of eight players, a goalkeeper (4) and a referee (9); 8 is seldom seen."""
    t, p = fx.tracks(s, d).where("track_id <> 8 or frame % 50 = 0"), F.col("track_id")
    shirt = F.when(p == 9, 3).when(p == 4, 2).when(p < 5, 0).otherwise(1)
    shade = lambda *v: F.element_at(F.array(*(F.lit(float(x)) for x in v)), shirt + 1) + (F.col("frame") * 7 + p * 3) % 5 + p
    cols = {"r": shade(200, 40, 20, 90), "g": shade(30, 60, 20, 10), "b": shade(40, 200, 20, 70), "h": shade(5, 110, 0, 30), "s": shade(200, 190, 10, 60), "v": shade(200, 200, 25, 80), "lab_l": shade(120, 90, 110, 10), "lab_a": shade(180, 130, 200, 110), "lab_b": shade(160, 70, 110, 250), "valid_fraction": F.lit(0.5), "valid_pixels": F.lit(300.0), "crop_area": F.lit(900.0), "box_width": F.lit(30.0), "box_height": F.col("height"), "green_fraction": F.lit(0.125)}
    return t.select("clip_id", "track_id", "frame", "confidence", *(v.cast("double").alias(k) for k, v in cols.items()))


def _groups(name: str, rows: str, k: int) -> str:
    """name: (clip_id, track_id, x, y, z, label) of rows (the same without label): the partition of a clip's rows into at most k groups that has the least squared distances from the groups' means, of all there are; groups numbered by their means."""
    return f""", {name}_rows AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY track_id) AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM {rows}),
{name}_all AS (SELECT row_number() OVER () AS id, l, g FROM growth WHERE most <= {k}),
{name}_sums AS (SELECT clip_id, id, g[i] AS part, sum(x * x + y * y + z * z) - (sum(x) ^ 2 + sum(y) ^ 2 + sum(z) ^ 2) / count(*) AS off FROM {name}_rows r JOIN {name}_all a ON a.l = r.n GROUP BY clip_id, id, part),
{name}_best AS (SELECT clip_id, arg_min(id, off) AS id FROM (SELECT clip_id, id, sum(off) AS off FROM {name}_sums GROUP BY 1, 2) GROUP BY 1),
{name}_parts AS (SELECT r.clip_id, track_id, x, y, z, g[i] AS part FROM {name}_rows r JOIN {name}_best b ON b.clip_id = r.clip_id JOIN {name}_all a ON a.id = b.id),
{name} AS (SELECT p.clip_id, track_id, x, y, z, label FROM {name}_parts p JOIN (SELECT clip_id, part, row_number() OVER (PARTITION BY clip_id ORDER BY avg(x), avg(y), avg(z)) - 1 AS label FROM {name}_parts GROUP BY 1, 2) q ON q.clip_id = p.clip_id AND q.part = p.part)"""


def _scaled(name: str, rows: str, of: str) -> str:
    """name: rows (clip_id, track_id, lab_a, lab_b, lab_l) as x, y, z in robust deviations of the rows `of`."""
    cols = (("lab_a", "x", "1"), ("lab_b", "y", "1"), ("lab_l", "z", "0.65::DOUBLE"))
    dev = ", ".join(f"median(abs({c} - m_{c})) * 1.4826::DOUBLE AS d_{c}, stddev_pop({c}) AS s_{c}, any_value(m_{c}) AS m_{c}" for c, _, _ in cols)
    out = ", ".join(f"({c} - m_{c}) / CASE WHEN d_{c} >= 1e-6 THEN d_{c} WHEN s_{c} >= 1e-6 THEN s_{c} ELSE 1 END * {w} AS {x}" for c, x, w in cols)
    return f""", {name}_scale AS (SELECT clip_id, {dev} FROM (SELECT *, {", ".join(f"median({c}) OVER (PARTITION BY clip_id) AS m_{c}" for c, _, _ in cols)} FROM {of}) GROUP BY clip_id),
{name} AS (SELECT r.clip_id, track_id, {out} FROM {rows} r JOIN {name}_scale s ON s.clip_id = r.clip_id)"""


_SAMPLES = """, growth AS (SELECT 1 AS l, [1] AS g, 1 AS most UNION ALL SELECT l + 1, list_append(g, x), greatest(most, x) FROM growth, (SELECT unnest(range(1, 6)) AS x) WHERE l < 10 AND x <= most + 1),
shade AS (SELECT *, CASE WHEN track_id = 9 THEN 4 WHEN track_id = 4 THEN 3 WHEN track_id < 5 THEN 1 ELSE 2 END AS k, (frame * 7 + track_id * 3) % 5 + track_id AS plus FROM tracks WHERE track_id <> 8 OR frame % 50 = 0),
tc AS (SELECT clip_id, track_id, count(*) AS frames_used, median(confidence) AS confidence, median(height) AS box_height, """ + ", ".join(f"median({v}[k] + plus)::DOUBLE AS {c}" for c, v in (("r", [200, 40, 20, 90]), ("g", [30, 60, 20, 10]), ("b", [40, 200, 20, 70]), ("h", [5, 110, 0, 30]), ("s", [200, 190, 10, 60]), ("v", [200, 200, 25, 80]), ("lab_l", [120, 90, 110, 10]), ("lab_a", [180, 130, 200, 110]), ("lab_b", [160, 70, 110, 250]))) + """ FROM shade GROUP BY 1, 2)"""


@query("colour_groups", _SAMPLES + _scaled("z3", "tc", "tc") + _groups("k3", "z3", 4) + " SELECT clip_id, track_id, label::INT AS color_cluster FROM k3")
def _(s, d):
    """The best four groups of a clip's ten tracks."""
    colours = teams.track_colors(_samples(s, d))
    return kmeans.groups_of_clips(colours, "track_id", ["lab_a", "lab_b", "lab_l"], 4, "color_cluster", teams.WEIGHTS).select("clip_id", "track_id", "color_cluster")


_LIMIT = "median({c}) + greatest(1.15::DOUBLE, 3.5::DOUBLE * {mad})"
_TEAMS = (
    _SAMPLES + ", rel AS (SELECT * FROM tc WHERE frames_used >= 8)" + _scaled("zz", "tc", "rel") + ", z1 AS (SELECT zz.* FROM zz JOIN rel USING (clip_id, track_id))" + _groups("k1", "z1", 2)
    + """, own1 AS (SELECT *, count(*) OVER w AS n, sqrt((x - avg(x) OVER w) ^ 2 + (y - avg(y) OVER w) ^ 2 + (z - avg(z) OVER w) ^ 2) AS own FROM k1 WINDOW w AS (PARTITION BY clip_id, label)),
kept1 AS (SELECT *, n < 4 OR own <= med + greatest(1.15::DOUBLE, 3.5::DOUBLE * median(abs(own - med)) OVER w) AS keep FROM (SELECT *, median(own) OVER (PARTITION BY clip_id, label) AS med FROM own1) WINDOW w AS (PARTITION BY clip_id, label)),
two AS (SELECT clip_id, count(DISTINCT CASE WHEN keep THEN label END) = 2 AS both_ FROM kept1 GROUP BY 1),
z2 AS (SELECT k.clip_id, track_id, x, y, z FROM kept1 k JOIN two ON two.clip_id = k.clip_id WHERE keep OR NOT both_)""" + _groups("k2", "z2", 2)
    + """, own2 AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, avg(z) OVER w AS cz, sqrt((x - avg(x) OVER w) ^ 2 + (y - avg(y) OVER w) ^ 2 + (z - avg(z) OVER w) ^ 2) AS own FROM k2 WINDOW w AS (PARTITION BY clip_id, label)),
centre AS (SELECT o.clip_id, label, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, least(2.75::DOUBLE, greatest(1.15::DOUBLE, any_value(med) + greatest(1.15::DOUBLE, 3.5::DOUBLE * median(abs(own - med))))) AS cut, median(lab_b) AS mb, median(lab_a) AS ma, median(lab_l) AS ml FROM (SELECT *, median(own) OVER (PARTITION BY clip_id, label) AS med FROM own2) o JOIN tc USING (clip_id, track_id) GROUP BY 1, 2),
named AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY mb DESC, ma, ml DESC) - 1 AS side FROM centre),
dist AS (SELECT zz.clip_id, zz.track_id, side, cut, sqrt((x - cx) ^ 2 + (y - cy) ^ 2 + (z - cz) ^ 2) AS d FROM zz JOIN named n ON n.clip_id = zz.clip_id),
near AS (SELECT clip_id, track_id, arg_min(side, d) AS side, arg_min(cut, d) AS cut, min(d) AS d, max(d) - min(d) AS margin FROM dist GROUP BY 1, 2),
cls0 AS (SELECT n.*, tc.* EXCLUDE (clip_id, track_id), 0.55::DOUBLE * greatest(0, 1 - d / cut) + 0.25::DOUBLE * least(1, margin / cut) + 0.2::DOUBLE * least(1, frames_used / 8) AS sure, CASE WHEN d > cut THEN 'far_from_team_centroid' WHEN frames_used < 8 AND margin < 0.05 THEN 'ambiguous_weak_track' WHEN frames_used >= 8 THEN 'reliable_track' ELSE 'weak_track_near_centroid' END AS why FROM near n JOIN tc USING (clip_id, track_id)),
cls1 AS (SELECT *, why IN ('far_from_team_centroid', 'ambiguous_weak_track') AS out_ FROM cls0),
cls AS (SELECT clip_id, track_id, CASE WHEN out_ THEN 'Unknown' WHEN side = 0 THEN 'Team A' ELSE 'Team B' END AS team, (CASE WHEN out_ THEN -1 ELSE side END)::INT AS cluster_id, d AS cluster_distance, margin AS cluster_margin, sure AS assignment_confidence, why AS assignment_reason, cut AS distance_cutoff, frames_used, confidence, r, g, b, h, s, v, lab_l, lab_a, lab_b, box_height FROM cls1)"""
)
_CLS = ("clip_id", "track_id", "team", "cluster_id", "cluster_distance", "cluster_margin", "assignment_confidence", "assignment_reason", "distance_cutoff", "frames_used", "confidence", "r", "g", "b", "h", "s", "v", "lab_l", "lab_a", "lab_b", "box_height")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("cluster_distance", "cluster_margin", "assignment_confidence", "distance_cutoff", "confidence"))


def _classified(s, d):
    return teams.classify_teams(_samples(s, d), fx.tracks(s, d))


@query("classify_teams", _TEAMS + f" SELECT * REPLACE ({_ROUND}), CASE team WHEN 'Team A' THEN 'team_a_player' WHEN 'Team B' THEN 'team_b_player' ELSE 'unknown' END AS role FROM cls")
def _(s, d):
    return rounded(_classified(s, d).select(*_CLS, "role"))


@query("team_cluster_summary", _TEAMS + " SELECT clip_id, cluster_id, team, count(*) AS tracks_used, " + ", ".join(f"median({c}) AS center_{c}" for c in ("r", "g", "b", "h", "s", "v", "lab_l", "lab_a", "lab_b")) + ", round(max(distance_cutoff), 6) AS distance_cutoff FROM cls WHERE team <> 'Unknown' AND assignment_reason = 'reliable_track' GROUP BY 1, 2, 3")
def _(s, d):
    return rounded(teams.cluster_summary(_classified(s, d)))


_PLACES = f""", moved AS (SELECT * REPLACE (CASE WHEN track_id = 4 THEN center_x * 0.125::DOUBLE WHEN track_id = 9 OR clip_id >= 6 THEN center_x WHEN track_id < 5 THEN center_x * 0.5::DOUBLE ELSE center_x * 0.5::DOUBLE + 640 END AS center_x) FROM tracks),
pos AS (SELECT clip_id, track_id, count(*) AS track_frames, min(frame) AS first_frame, max(frame) AS last_frame, median(center_x) AS median_x, min(center_x) AS min_x, max(center_x) AS max_x, median(center_y) AS median_y, min(center_y) AS min_y, max(center_y) AS max_y, coalesce(sum(step), 0) AS movement_distance, (20 + 2 * track_id)::DOUBLE AS median_box_width, median(height) AS median_box_height, max(center_x) - min(center_x) AS span_x, max(center_y) - min(center_y) AS span_y FROM (SELECT *, sqrt((center_x - lag(center_x) OVER w) ^ 2 + (center_y - lag(center_y) OVER w) ^ 2) AS step FROM moved WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)) GROUP BY clip_id, track_id)"""
_CLUSTERED = _TEAMS + _PLACES + _scaled("z3", "tc", "tc") + _groups("k3", "z3", 4) + ", rl0 AS (SELECT cls.*, label::INT AS color_cluster, pos.* EXCLUDE (clip_id, track_id) FROM cls JOIN k3 USING (clip_id, track_id) JOIN pos USING (clip_id, track_id))"
_ROLES = _CLUSTERED + f""", cnt AS (SELECT clip_id, team, color_cluster, count(*) AS n FROM rl0 WHERE team <> 'Unknown' AND frames_used >= 8 GROUP BY 1, 2, 3),
usual AS (SELECT DISTINCT clip_id, color_cluster FROM (SELECT *, greatest(4, ceil(max(n) OVER (PARTITION BY clip_id, team) * 0.4::DOUBLE)) AS least_ FROM cnt) WHERE n >= least_),
rl1 AS (SELECT rl0.*, usual.clip_id IS NULL AS odd, quantile_cont(CASE WHEN team <> 'Unknown' THEN movement_distance END, 0.6) OVER w AS way6, median(CASE WHEN team = 'Team A' THEN median_x END) OVER w AS ax, median(CASE WHEN team = 'Team B' THEN median_x END) OVER w AS bx FROM rl0 LEFT JOIN usual ON usual.clip_id = rl0.clip_id AND usual.color_cluster = rl0.color_cluster WINDOW w AS (PARTITION BY rl0.clip_id)),
rl2 AS (SELECT *, CASE WHEN odd AND frames_used >= 8 AND track_frames >= 60 THEN CASE WHEN median_x <= {WIDTH} * 0.18::DOUBLE THEN 'left' WHEN median_x >= {WIDTH} * 0.82::DOUBLE THEN 'right' END END AS side, 0.45::DOUBLE * least(1, track_frames / 60) + 0.35::DOUBLE * (1 - least(1, movement_distance / greatest(way6, 1))) + 0.2::DOUBLE AS score FROM rl1),
rl3 AS (SELECT *, side IS NOT NULL AND score >= 0.45 AND row_number() OVER (PARTITION BY clip_id, side ORDER BY score DESC, track_frames DESC, team, track_id) = 1 AS keeper, CASE WHEN abs(ax - bx) >= {WIDTH} * 0.15::DOUBLE THEN CASE WHEN (ax < bx) = (side = 'left') THEN 'Team A' ELSE 'Team B' END END AS owner FROM rl2),
rl4 AS (SELECT *, CASE WHEN keeper THEN coalesce(owner, 'Unknown') ELSE team END AS team1 FROM rl3),
rl5 AS (SELECT *, odd AND frames_used >= 8 AND track_frames >= 20 AND median_x BETWEEN {WIDTH} * 0.25::DOUBLE AND {WIDTH} * 0.75::DOUBLE AND cluster_distance >= 2.1 AS central, 0.55::DOUBLE * least(1, cluster_distance / 2.1::DOUBLE) + 0.45::DOUBLE * least(1, movement_distance / greatest(median(CASE WHEN team1 <> 'Unknown' THEN movement_distance END) OVER (PARTITION BY clip_id), 1)) AS score2 FROM rl4),
rl6 AS (SELECT *, NOT keeper AND central AND row_number() OVER (PARTITION BY clip_id, central ORDER BY score2 DESC, track_frames DESC, team1, track_id) <= 4 AS official FROM rl5)"""


def _placed(s, d):
    c = _classified(s, d).drop("role", "role_confidence", "role_reason").join(roles.track_positions(_tracks(s, d)), ["clip_id", "track_id"])
    return roles.colour_clusters(c, 4)


_POS = ("track_frames", "first_frame", "last_frame", "median_x", "min_x", "max_x", "median_y", "min_y", "max_y", "movement_distance", "median_box_width", "median_box_height", "span_x", "span_y")


@query("track_positions", _PLACES + " SELECT * REPLACE (round(movement_distance, 3) AS movement_distance, round(median_x, 6) AS median_x, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(span_x, 6) AS span_x) FROM pos")
def _(s, d):
    return rounded(roles.track_positions(_tracks(s, d)).withColumn("movement_distance", F.round("movement_distance", 3)))


@query("role_colour_summary", _CLUSTERED + " SELECT clip_id, color_cluster, count(*) AS tracks, count(*) FILTER (frames_used >= 8) AS reliable_tracks, count(*) FILTER (team = 'Team A') AS team_a_tracks, count(*) FILTER (team = 'Team B') AS team_b_tracks, count(*) FILTER (team = 'Unknown') AS unknown_tracks, " + ", ".join(f"median({c}) AS median_{c}" for c in ("r", "g", "b", "lab_l", "lab_a", "lab_b")) + ", round(median(median_x), 6) AS median_x, median(median_y) AS median_y, round(median(movement_distance), 3) AS median_movement FROM rl0 GROUP BY 1, 2")
def _(s, d):
    return rounded(roles.colour_cluster_summary(_placed(s, d)).withColumn("median_movement", F.round("median_movement", 3)))


@query("player_roles", _ROLES + """ SELECT clip_id, track_id, color_cluster, odd AS role_color_outlier, CASE WHEN official THEN 'Unknown' ELSE team1 END AS team,
CASE WHEN official THEN 'referee' WHEN keeper AND owner = 'Team A' THEN 'team_a_goalkeeper' WHEN keeper AND owner = 'Team B' THEN 'team_b_goalkeeper' WHEN keeper THEN 'goalkeeper_' || side WHEN team1 = 'Team A' THEN 'team_a_player' WHEN team1 = 'Team B' THEN 'team_b_player' ELSE 'unknown' END AS role,
round(CASE WHEN official THEN greatest(assignment_confidence, score2) WHEN keeper THEN greatest(assignment_confidence, score) ELSE assignment_confidence END, 6) AS role_confidence,
CASE WHEN official THEN 'color_outlier_central_official_candidate' WHEN keeper THEN 'color_outlier_near_' || side || '_goal' WHEN team <> 'Unknown' THEN 'outfield_color_cluster' ELSE assignment_reason END AS role_reason FROM rl6""")
def _(s, d):
    return rounded(roles.team_sheet(_samples(s, d), _tracks(s, d), WIDTH, colours=4).select("clip_id", "track_id", "color_cluster", "role_color_outlier", "team", "role", "role_confidence", "role_reason"))
