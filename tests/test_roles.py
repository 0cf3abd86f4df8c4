"""k-means against all partitions, teams with an odd track, roles by hand."""

import numpy as np
import pytest

from touchline.operators import roles, teams
from touchline.operators.kmeans import kmeans


def partitions(n, k, g=(0,)):
    if len(g) == n:
        yield g
        return
    for x in range(min(k, max(g) + 2)):
        yield from partitions(n, k, (*g, x))


def inertia(x, g):
    g = np.array(g)
    return sum(((x[g == j] - x[g == j].mean(0)) ** 2).sum() for j in set(g.tolist()))


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("seed", range(6))
def test_kmeans_finds_the_best_partition(k, seed):
    x = np.random.default_rng(seed).normal(size=(8, 3)) * (1 + 2 * (seed % 2))
    labels, centres, off = kmeans(x, k)
    assert off == pytest.approx(min(inertia(x, g) for g in partitions(8, k))) == pytest.approx(inertia(x, labels))
    assert [tuple(c) for c in centres] == sorted(tuple(c) for c in centres)
    again = kmeans(x[::-1], k)[0][::-1]
    assert inertia(x, again) == pytest.approx(off)


def test_kmeans_of_equal_and_few_rows():
    labels, centres, off = kmeans(np.zeros((5, 2)), 2)
    assert off == 0 and len(labels) == 5
    assert sorted(kmeans(np.array([[1.0], [0.0]]), 5)[0]) == [0, 1]


def test_one_odd_track_does_not_take_a_group_for_itself():
    x = np.array([[0.1 * (i % 3), 0.1 * (i % 2), 0] for i in range(10)] + [[3 + 0.1 * (i % 3), 0.1 * (i % 2), 0] for i in range(10)] + [[1.5, 6, 0]])
    labels, _, off = kmeans(x, 2)
    assert len(set(labels[:10])) == len(set(labels[10:20])) == 1 and labels[0] != labels[10] and off < 40


def colour_samples(spark, shades, n=10):
    names = [*teams.MEDIANS, "green_fraction"]
    base = dict.fromkeys(names, 1.0) | {"valid_fraction": 0.5, "green_fraction": 0.1, "crop_area": 900.0}
    rows = [(1, t, *({**base, "lab_a": float(a), "lab_b": float(b), "lab_l": light}[n] for n in names)) for t, (a, b, light) in enumerate(shades) for _ in range(n)]
    return spark.createDataFrame(rows, "clip_id long, track_id long, " + ", ".join(f"{n} double" for n in names))


def test_an_odd_track_leaves_two_teams(spark):
    shades = [(100 + i % 2, 96 + i % 3 * 4, 50.0) for i in range(10)] + [(130 + i % 2, 96 + i % 3 * 4, 50.0) for i in range(10)] + [(115, 117, 50.0)]
    samples = colour_samples(spark, shades)
    got = {r.track_id: r.team for r in teams.classify_teams(samples, samples).collect()}
    assert len({got[i] for i in range(10)}) == len({got[i] for i in range(10, 20)}) == 1
    assert {got[0], got[10]} == {"Team A", "Team B"} and got[20] == "Unknown"


def role_rows(spark, rows):
    shape = "clip_id long, track_id long, team string, color_cluster int, frames_used long, assignment_confidence double, assignment_reason string, cluster_distance double, track_frames long, median_x double, movement_distance double"
    return spark.createDataFrame([(1, *r) for r in rows], shape)


def squad(a_x, b_x):
    return [(i, "Team A", 0, 20, 0.9, "reliable_track", 0.5, 200, a_x, 1000.0) for i in range(5)] + [(10 + i, "Team B", 1, 20, 0.9, "reliable_track", 0.5, 200, b_x, 1000.0) for i in range(5)]


def test_goalkeepers_and_referees(spark):
    rows = squad(300.0, 900.0)
    rows += [
        (20, "Unknown", 2, 20, 0.2, "far_from_team_centroid", 3.0, 200, 50.0, 100.0),  # the left goalkeeper
        (21, "Unknown", 2, 20, 0.2, "far_from_team_centroid", 3.0, 70, 60.0, 900.0),  # before the same goal, less still
        (22, "Team A", 3, 20, 0.8, "reliable_track", 1.0, 30, 1250.0, 0.0),  # before the right goal, but too short
        (30, "Unknown", 4, 20, 0.1, "far_from_team_centroid", 3.0, 100, 640.0, 2000.0),  # a referee
        (31, "Unknown", 4, 20, 0.1, "far_from_team_centroid", 1.0, 100, 640.0, 2000.0),  # too near to a team's colour
        (32, "Team B", -1, 20, 0.7, "reliable_track", 3.0, 100, 640.0, 2000.0),  # no colour
    ] + [(40 + i, "Unknown", 4, 20, 0.1, "far_from_team_centroid", 3.0, 100, 640.0, 10.0 * i) for i in range(5)]
    got = {r.track_id: r for r in roles.assign_roles(role_rows(spark, rows), 1280).collect()}
    assert (got[20].role, got[20].team, got[20].role_reason) == ("team_a_goalkeeper", "Team A", "color_outlier_near_left_goal")
    assert got[20].role_confidence == pytest.approx(0.45 + 0.35 * 0.9 + 0.2)
    assert (got[21].role, got[22].role, got[22].team) == ("unknown", "team_a_player", "Team A")
    assert [t for t in got if got[t].role == "referee"] and {t for t in got if got[t].role == "referee"} == {30, 42, 43, 44}
    assert (got[30].team, got[30].role_confidence) == ("Unknown", pytest.approx(1.0)) and got[31].role == "unknown"
    assert (got[32].role, got[32].role_color_outlier, got[0].role, got[0].role_color_outlier) == ("team_b_player", True, "team_a_player", False)


def test_goalkeepers_of_halves_that_cannot_be_told(spark):
    rows = squad(600.0, 700.0) + [(20, "Team A", 2, 20, 0.2, "reliable_track", 1.0, 200, 50.0, 0.0), (21, "Team A", 2, 20, 0.2, "reliable_track", 1.0, 200, 1279.0, 0.0)]
    got = {r.track_id: (r.role, r.team) for r in roles.assign_roles(role_rows(spark, rows), 1280).collect()}
    assert got[20] == ("goalkeeper_left", "Unknown") and got[21] == ("goalkeeper_right", "Unknown")
    got = {r.track_id: (r.role, r.team) for r in roles.assign_roles(role_rows(spark, squad(900.0, 300.0) + rows[10:]), 1280).collect()}
    assert got[20] == ("team_b_goalkeeper", "Team B") and got[21] == ("team_a_goalkeeper", "Team A")
