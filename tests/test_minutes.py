"""Votes from minutes of our own making, in each form."""

from quillspark.operators import minutes

LINES = """1.
Call to order
Page 1 of 2
Adoption of Agenda
Move to approve the agenda
as posted.
Moved by: Ms. Ann Lee; seconded by: Mr. Bo Ray
Votes: Ann Lee-aye, Bo Ray-aye, Cy Day-no
Carried
2.1
DESCRIPTION: words that are no motion
Motion to award the paving contract.
Moved by: Mr. Bo Ray
Seconded by: Ms. Ann Lee
Aye
Ms. Ann Lee, Mr. Bo Ray
and Mr. Cy Day
Nay
Ms. Di Fox
Motion Carries 3-1
Approve the minutes of the last meeting.
Moved by: Ms. Di Fox
Seconded by: Mr. Cy Day
Yes: Ms. Ann Lee, Mr. Bo Ray, and Ms. Di Fox
No: Mr. Cy Day, Mr. Ed Orr and Ms. Flo Ash
3.
Motion to amend the budget of the year.
Moved by: Mr. Cy Day
Seconded by: Mr. Bo Ray
Yes: Ms. Ann Lee
No: Mr. Cy Day, Mr. Bo Ray
4.
Motion to table the new rules.
Moved by: Ann Lee
Motion Fails 2-4-1
The meeting adjourned at 8 p.m.
Moved by: Ann Lee
Carried
5.
Motion to hire a clerk.
Moved by: Ann Lee
Yes: Ann Lee, Bo Ray
Motion Carries 5-0
Receipt of the report is hereby noted.
Moved by: Bo Ray
All aye
"""
COUNCIL = """Motion made by Councilmember Buse to approve the Consent Agenda. Councilmember Patel seconded. The motion passed unanimously (7-0) on a voice vote.
Alderman Boulton moved to approve Bill No. 7 as read. Alderman Garn seconded. The motion failed 2 - Ayes to 5 - Nays on a voice vote. Talk went on.
Councilmember Buse introduced Bill No. 7157, an ordinance, by title only. Councilmember Patel seconded. Alderman Garn - Aye; Alderman Boulton - Aye; and Mayor Pro Tempore Harris - Nay. The bill was adopted and became Ordinance No. 6352.
Acting Mayor Smith moved that the meeting end now. Alderman Garn - Aye; Alderman Boulton - Nay. The motion was never decided."""
BOARD = """The board met. Steve Lich made a motion to approve the plan with conditions. Bob Denlow seconded the motion. The motion carried with five votes in favor and one opposed. Ann Poe made a motion to continue the case. The motion was seconded by Steve Lich and unanimously approved by the Board."""


def test_forms(spark):
    docs = spark.createDataFrame([(1, LINES), (2, COUNCIL), (3, BOARD), (4, "We moved to the next room."), (5, None), (6, "")], "doc int, text string")
    votes = minutes.extract_votes(docs, "doc", "text")
    got = {(r["doc"], r["motion_no"]): (r["motion"], r["moved_by"], r["seconded_by"], r["result"], r["basis"], r["yes"], r["no"], r["abstain"]) for r in votes.collect()}
    assert got == {
        (1, 1): ("Move to approve the agenda as posted.", "Ms. Ann Lee", "Mr. Bo Ray", "passed", "stated", 2, 1, 0),
        (1, 2): ("Motion to award the paving contract.", "Mr. Bo Ray", "Ms. Ann Lee", "passed", "stated", 3, 1, 0),
        # (1, 3) is a tie without a result
        (1, 4): ("Motion to amend the budget of the year.", "Mr. Cy Day", "Mr. Bo Ray", "failed", "derived", 1, 2, 0),
        (1, 5): ("Motion to table the new rules.", "Ann Lee", None, "failed", "stated", 2, 4, 1),
        # (1, 6) has no motion
        (1, 7): ("Motion to hire a clerk.", "Ann Lee", None, "passed", "stated", None, None, None),
        (1, 8): ("Receipt of the report is hereby noted.", "Bo Ray", None, "passed", "stated", None, None, None),
        (2, 1): ("Motion made by Councilmember Buse to approve the Consent Agenda", "Councilmember Buse", "Councilmember Patel", "passed", "stated", 7, 0, 0),
        (2, 2): ("Alderman Boulton moved to approve Bill No. 7 as read", "Alderman Boulton", "Alderman Garn", "failed", "stated", 2, 5, 0),
        (2, 3): ("Councilmember Buse introduced Bill No. 7157, an ordinance, by title only", "Councilmember Buse", "Councilmember Patel", "passed", "stated", 2, 1, 0),
        (3, 1): ("Steve Lich made a motion to approve the plan with conditions", "Steve Lich", "Bob Denlow", "passed", "stated", 5, 1, 0),
        (3, 2): ("Ann Poe made a motion to continue the case", "Ann Poe", "Steve Lich", "passed", "stated", None, None, None),
    }
    told = {r["form"]: tuple(r)[1:] for r in minutes.audit(docs, votes, "doc", "text").collect()}
    assert told == {"lines": (1, 8, 6), "council": (1, 4, 3), "board": (1, 2, 2), "none": (3, 0, 0)}
    assert minutes.extract_votes(docs.limit(0), "doc", "text").count() == 0


def test_lines_are_dealt_and_read_once(spark):
    text = "\n".join(f"Motion to pay bill {k} now\nMoved by: Ann\nSeconded by: Bo\nVotes: Ann-aye, Bo-aye\nAyes: Cy and Di\nEd\nNays:\nFay\n{'Motion carries 5-1' if k % 2 else ''}\n{k}." for k in range(40))
    df = spark.createDataFrame([(1, text), (2, None), (3, "Moved by: Ann\nAll ayes")], "id long, text string")
    got = minutes.line_votes(df, "id", "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan  # all parts of a block come from one sorted pass
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[1] for r in rows] == list(range(1, 41)) and {r[0] for r in rows} == {1}
    for k, r in enumerate(rows):
        assert r[2:5] == (f"Motion to pay bill {k} now", "Ann", "Bo")
        assert r[5] == "passed" and r[6] == ("stated" if k % 2 else "derived")
