"""Queries of the tables behind pictures and reports, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motion, pictures, segments
from ..sources import fixtures as fx
from ..sources.files import saved
from .catalog import _CARRY, _INTER, _PASS, _STEPS, _stable, query, rounded

SIZE = (1280, 720)


@query("pixel_density", """SELECT clip_id, round_even(center_x, 0)::BIGINT AS px, round_even(center_y, 0)::BIGINT AS py, count(*) AS points FROM ball WHERE round_even(center_x, 0) BETWEEN 0 AND 1279 AND round_even(center_y, 0) BETWEEN 0 AND 719 GROUP BY 1, 2, 3""")
def _(s, d):
    return pictures.density(fx.ball(s, d), *SIZE, "clip_id")


@query("team_points", """SELECT clip_id, track_id, frame, center_x, center_y, CASE WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS team FROM tracks WHERE track_id NOT IN (4, 9)""")
def _(s, d):
    return pictures.team_points(fx.tracks(s, d), fx.teams(s, d)).select("clip_id", "track_id", "frame", "center_x", "center_y", "team")


@query("carry_lines", _CARRY + "SELECT clip_id, carry_id, team, player_id, start_ball_x, start_ball_y, end_ball_x, end_ball_y, round(ball_distance_px, 6) AS ball_distance_px, round(duration_seconds, 6) AS duration_seconds FROM carry WHERE ball_distance_px >= 40")
def _(s, d):
    return rounded(pictures.carry_lines(segments.estimate_carries(fx.owners(s, d), fx.tracks(s, d)), 40))


@query("interception_points", _INTER + "SELECT clip_id, interception_id, winner_team AS team, winner_player_id AS player_id, ball_x, ball_y FROM inter WHERE ball_x IS NOT NULL AND ball_y IS NOT NULL")
def _(s, d):
    return pictures.interception_points(segments.detect_interceptions(fx.owners(s, d)))


_LINES = _PASS + """, ln AS (SELECT p.clip_id, pass_id, team, from_player, to_player, a.center_x AS from_x, a.center_y AS from_y, b.center_x AS to_x, b.center_y AS to_y FROM pass p JOIN tracks a ON a.clip_id = p.clip_id AND a.track_id = p.from_player AND a.frame = p.start_frame JOIN tracks b ON b.clip_id = p.clip_id AND b.track_id = p.to_player AND b.frame = p.end_frame)"""


def _lines(s, d):
    return pictures.pass_lines(segments.weak_passes(_stable(s, d)), fx.tracks(s, d))


@query("pass_lines", _LINES + " SELECT * FROM ln")
def _(s, d):
    return _lines(s, d)


@query("pass_edges", _LINES + " SELECT clip_id, team, from_player, to_player, count(*) AS passes, round(avg(from_x), 6) AS mean_from_x, round(avg(from_y), 6) AS mean_from_y, round(avg(to_x), 6) AS mean_to_x, round(avg(to_y), 6) AS mean_to_y FROM ln GROUP BY 1, 2, 3, 4")
def _(s, d):
    return rounded(pictures.pass_edges(_lines(s, d)))


def _summary(table: str, total: str, at: str, player: str, team: str, more: str = "") -> str:
    return f"""SELECT clip_id, 'counts' AS section, '{total}' AS metric, count(*)::DOUBLE AS "value" FROM {table} GROUP BY 1
UNION ALL SELECT clip_id, 'teams', {team}, count(*) FROM {table} GROUP BY 1, 3{more}
UNION ALL SELECT clip_id, section, metric, n FROM (SELECT clip_id, 'players' AS section, {player}::VARCHAR AS metric, count(*) AS n, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, min({at}), {player}::VARCHAR) AS r FROM {table} GROUP BY clip_id, {player}) WHERE r <= 3"""


@query("interception_summary", _INTER + _summary("inter", "total_interceptions", "frame", "winner_player_id", "winner_team"))
def _(s, d):
    return pictures.event_summary(segments.detect_interceptions(fx.owners(s, d)), "total_interceptions", "frame", 3, "winner_player_id", "winner_team")


@query("carry_summary", _CARRY + _summary("carry", "total_carries", "start_frame", "player_id", "team", """
UNION ALL SELECT clip_id, 'metrics', 'avg_duration_seconds', round(avg(duration_seconds), 6) FROM carry GROUP BY 1
UNION ALL SELECT clip_id, 'metrics', 'max_ball_distance_px', round(max(ball_distance_px), 6) FROM carry GROUP BY 1
UNION ALL SELECT clip_id, 'dynamic_distance', 'avg_mean_player_box_height', round(avg(mean_player_box_height), 6) FROM carry GROUP BY 1"""))
def _(s, d):
    more = {"avg_duration_seconds": ("metrics", F.avg("duration_seconds")), "max_ball_distance_px": ("metrics", F.max("ball_distance_px")), "avg_mean_player_box_height": ("dynamic_distance", F.avg("mean_player_box_height"))}
    carries = saved(segments.estimate_carries(fx.owners(s, d), fx.tracks(s, d)))  # the summary reads them several times
    return rounded(pictures.event_summary(carries, "total_carries", "start_frame", 3, metrics=more))


@query("readable_player_stats", _STEPS + """SELECT clip_id, track_id AS "Player ID", n AS "Frames Seen", round(c, 3) AS "Average Confidence", round(l, 2) AS "Total Distance (pixels)", round(CASE WHEN t > 0 THEN l / t ELSE 0 END, 2) AS "Average Speed (pixels/sec)", round(t, 2) AS "Time Visible (sec)" FROM (SELECT clip_id, track_id, count(*) AS n, avg(confidence) AS c, coalesce(sum(step), 0) AS l, max("timestamp") - min("timestamp") AS t FROM steps GROUP BY 1, 2)""")
def _(s, d):
    return pictures.readable_player_stats(motion.player_stats(fx.tracks(s, d)))


@query("counted_passes", """, near AS (SELECT b.clip_id, b.frame, arg_min(track_id, sqrt((b.center_x - p.center_x) ^ 2 + (b.center_y - p.center_y) ^ 2) + track_id * 1e-9) AS who, min(sqrt((b.center_x - p.center_x) ^ 2 + (b.center_y - p.center_y) ^ 2)) AS d, arg_min(height, sqrt((b.center_x - p.center_x) ^ 2 + (b.center_y - p.center_y) ^ 2) + track_id * 1e-9) AS height FROM ball b JOIN tracks p ON p.clip_id = b.clip_id AND p.frame = b.frame GROUP BY 1, 2),
held AS (SELECT *, CASE WHEN who IN (4, 9) THEN 'Unknown' WHEN who < 5 THEN 'Team A' ELSE 'Team B' END AS team FROM near WHERE d < height * 1.5::DOUBLE), mv AS (SELECT *, lag(who) OVER w AS w0, lag(team) OVER w AS t0 FROM held WINDOW w AS (PARTITION BY clip_id ORDER BY frame))
SELECT clip_id, count(*) FILTER (w0 <> who AND team = t0 AND team <> 'Unknown') AS successful, count(*) FILTER (w0 <> who AND team <> t0 AND team <> 'Unknown' AND t0 <> 'Unknown') AS failed FROM mv GROUP BY 1""")
def _(s, d):
    return pictures.counted_passes(fx.ball(s, d), fx.tracks(s, d), fx.teams(s, d))
