"""The rate controller: its promises one by one, and against a fold written apart from it."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.operators import ladder

POLICY, SIGNALS = ladder.Policy(), ladder.Signals(demand=5000, model_requests=100)


def play(outcomes, level=1, policy=POLICY, signals=SIGNALS, gap=60.0, day=None, state=None, start=1e9):
    """Outcomes may carry a block: ``neutral+challenge``."""
    s, moves = state or ladder.State(level=level, active=True), []
    for k, o in enumerate(outcomes):
        t = start + k * gap
        outcome, _, block = o.partition("+")
        moves.append(ladder.step(s, t, int(t // 86_400) if day is None else day, outcome, policy, signals, block or None))
        s = ladder.State.of(s.json())
    return s, moves


def test_climbs_after_enough_clean_answers():
    assert play(["clean"] * 200)[0].level == 2
    assert play(["clean"] * 199)[0].level == 1


@pytest.mark.parametrize("signals", [ladder.Signals(demand=500), ladder.Signals(model_requests=950), ladder.Signals(age=601)])
def test_stays_without_demand_budget_or_news(signals):
    assert play(["clean"] * 300, signals=signals)[0].level == 1


def test_falls():
    s, moves = play(["refused"] * 4, level=4)
    assert (s.level, moves[-1], s.trailing) == (2, "fall", []) and s.stint(4).blocked_until > 0
    s, moves = play(["clean"] * 7 + ["refused"] * 3, level=3)
    assert (s.level, moves[-1]) == (2, "fall")
    assert play(["refused" if k % 11 == 5 else "clean" for k in range(300)])[0].level == 1  # 9 % refused


def test_neutral_answers_are_in_the_window_and_end_a_streak():
    s, moves = play(["refused", "neutral"] * 3 + ["refused"], level=4)
    assert s.level == 4 and set(moves) == {"stay"} and len(s.trailing) == 7
    # 3 of 10 are refused, with neutral ones between
    assert play(["refused", "neutral", "neutral"] * 3 + ["neutral"], level=4)[0].level == 3


def test_no_climb_while_one_of_the_last_four_was_refused():
    s, moves = play(["clean"] * 199 + ["refused"] + ["clean"] * 3)
    assert s.level == 1 and ladder.blocker(s, POLICY, SIGNALS, 2e9) == "not calm"
    assert play(["clean"] * 199 + ["refused"] + ["clean"] * 4)[0].level == 2


def test_the_rate_is_of_clean_answers():
    s = ladder.State(level=2, active=True, stints={"1": ladder.Stint(requests=300, clean=300, seconds=30_000.0), "2": ladder.Stint(requests=300, clean=150, refused=0, seconds=20_000.0, last_at=1e9)})
    # 300 requests in 20,000 s are more an hour than 300 in 30,000 s, but 150 clean ones aren't
    assert ladder.blocker(s, POLICY, SIGNALS, 1e9) == "no faster"
    assert ladder.blocker(s, POLICY, SIGNALS, 1e9, throughput=False) is None


def test_the_release_of_a_brake_clears_window_and_stint():
    s, moves = play(["clean"] * 5 + ["neutral+challenge"] + ["clean"] * 20, level=3)
    assert moves[5] == "brake" and moves[-1] == "brake released"
    assert s.level == 1 and s.brake_since is None and s.trailing == [] and s.stint(1).requests == 0


def test_connection_errors_brake_only_together():
    s, moves = play(["neutral+connection"] * 3, level=2)
    assert moves == ["stay", "stay", "brake"]
    assert "brake" not in play(["neutral+connection"] * 9, level=2, gap=400.0)[1]


def test_a_block_that_goes_on_pauses_the_day():
    s, moves = play(["neutral+challenge"] * 2, gap=4000.0, day=5)
    assert moves == ["brake", "paused for the day"]
    s, moves = play(["clean"], state=s, day=5)
    assert moves == ["paused"]
    s, moves = play(["clean"], state=s, day=6, start=1e9 + 90_000)
    assert s.paused_day is None and s.level == 1 and moves == ["stay"]
    # ten clean answers in between make a new episode
    assert play(["neutral+challenge"] + ["clean"] * 10 + ["neutral+challenge"], gap=400.0, day=5)[1][-1] == "brake"


def test_eases_without_demand_hourly():
    s, moves = play(["clean"] * 3, level=3, signals=ladder.Signals(demand=10))
    assert moves == ["ease", "stay", "stay"] and s.level == 2
    assert play(["clean"], level=7, signals=ladder.Signals(demand=10))[0].level == POLICY.hold_level


def test_a_fall_from_above_three_times_lands_below_and_holds():
    s, _ = play(["refused"] * 4, level=8)
    assert s.level == POLICY.hold_level and s.hold_until == 1e9 + 180 + POLICY.hold


def test_a_quiet_day_halves_cooldowns():
    s = ladder.State(active=True, day=1, requests_today=100, stints={"3": ladder.Stint(cooldown=4 * POLICY.cooldown)})
    assert play(["clean"], state=s, day=2)[0].stint(3).cooldown == 2 * POLICY.cooldown
    s.trouble_today, s.day = True, 2
    assert play(["clean"], state=s, day=3)[0].stint(3).cooldown == 2 * POLICY.cooldown


def test_switched_off():
    s, moves = play(["refused"] * 3, level=5, policy=replace(POLICY, enabled=False))
    assert moves == ["off"] * 3 and s.level == 1 and not s.active


def told_apart(events, level):
    """Levels by the order of checks, from lists of what happened since the last move; only what the test's policy can reach."""
    out, history, stints, blocked, cooldown, hours = [], [], {}, {}, {}, {}
    seen, day_now, requests, trouble, brake, clean, conn, paused, hold, climbs = [], None, 0, False, None, 0, [], None, 0.0, 0
    p = POLICY
    top = p.hold_level
    for t, day, outcome, block in events:
        if paused is not None:
            if paused == day:
                out.append(level)
                continue
            paused, brake, level, seen = None, None, 1, []
            stints[1], blocked[1] = [], 0
        if day != day_now:
            if day_now is not None and requests >= p.quiet_day_requests and not trouble:
                cooldown = {k: max(p.cooldown, c / 2) for k, c in cooldown.items()}
            day_now, requests, trouble, climbs = day, 0, False, 0
        seen.append(outcome)
        requests += 1
        hours[int(t // 3600)] = hours.get(int(t // 3600), 0) + 1
        if brake is None:
            stints.setdefault(level, []).append(outcome)
        if block == "connection":
            conn = [x for x in [*conn, t] if t - x <= 600]
        if block and (block != "connection" or len(conn) >= 3):
            before = clean if brake is not None else 0
            if brake is None or before >= 10:
                brake, trouble = t, True
            if level > top:
                hold = t + 86_400
            clean, level, seen = 0, 1, []
            stints[1], blocked[1] = [], 0
            if t - brake >= 3600 and before < 10:
                paused = day
            out.append(level)
            continue
        window = seen[-20:]
        share = window.count("refused") / len(window)
        to = level
        if brake is not None:
            clean = clean + 1 if outcome == "clean" else 0 if outcome == "refused" else clean
            if clean >= 20 and share < 0.3:
                brake, to = None, 1
                level = 0  # to begin level 1 anew
        else:
            row = 0
            while row < len(window) and window[-1 - row] == "refused":
                row += 1
            many = len(window) >= 10
            down = 2 if row >= 4 or many and share >= 0.5 else 1 if many and share >= 0.3 else 0
            if level > 1 and down:
                wait = cooldown.get(level, 7200)
                blocked[level], cooldown[level], trouble = t + wait, min(86_400, 2 * wait), True
                to = max(1, level - down)
                if level > top:
                    to, hold = min(to, top), t + 86_400
            elif outcome == "clean" and level < 8:
                own = stints[level]
                rolling = sum(n for h, n in hours.items() if h >= t // 3600 - 24)
                fast = level + 1 > top
                ready = len(own) >= (600 if fast else 200) and t >= blocked.get(level + 1, 0) and ladder.wilson(own.count("refused"), len(own)) < 0.12 and share < 0.3 and "refused" not in window[-4:]
                if ready and not (fast and (rolling >= 5000 or climbs or t < hold)):
                    to = level + 1
                    climbs += fast
        if to != level:
            level, seen = to, []
            stints[to], blocked[to] = [], 0
        out.append(level)
    return out


def test_replay_equals_a_fold_written_apart(spark):
    random.seed(5)
    kinds, weights = ["clean", "refused", "neutral"], {"calm": [60, 1, 1], "rough": [12, 3, 2], "blocked": [40, 1, 1]}
    hosts = {"calm": 4000, "rough": 2500, "blocked": 2500, None: 900}
    rows, want = [], {}
    for host, n in hosts.items():
        t, mood, events = 1.7e9, weights.get(host, weights["calm"]), []
        for k in range(n):
            t += random.choice([20.0, 60.0, 60.0, 400.0])
            if host == "rough" and k % 600 == 0:
                mood = random.choice([[80, 1, 1], [5, 3, 1]])
            block = random.choices([None, "challenge", "connection"], [300, 1, 3])[0] if host == "blocked" else None
            events.append((t, int((t + 7200) // 86_400), random.choices(kinds, mood)[0], block))
        for (t, day, outcome, block), level in zip(events, told_apart(events, 3), strict=True):
            want[len(rows)] = level
            rows.append((host, t, day, len(rows), outcome, block))
    df = spark.createDataFrame(rows, "host string, t double, day int, event_id long, outcome string, block string").repartition(3)
    got = ladder.replay(df, POLICY, SIGNALS, level=3).collect()
    assert {r.event_id: r.level for r in got} == want
    assert len({r.move for r in got}) >= 6 and len(set(want.values())) >= 4
    empty = ladder.replay(df.filter(F.lit(False)), POLICY, SIGNALS)
    assert empty.count() == 0
