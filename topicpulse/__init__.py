"""topicpulse — topic-trend analytics on Spark DataFrames.

Posts are matched to keyword topics (CNF rules), scored for engagement and
sentiment, kept as a keyed latest-state table and rolled up into gap-filled
day / week / month trend reports, calendar timelines and dashboard panels.
Everything is a DataFrame -> DataFrame function; ``as_of`` is always an
explicit argument so results are reproducible.
"""

from topicpulse.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
