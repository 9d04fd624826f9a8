"""Incremental per-video scores over a stream of scored comments.

The reference has no streaming part; this module only shows that the
scoring stage is streaming-ready as it is: every per-video aggregate is
decomposable (sums, counts, second moment), so the same aggregation runs
as a Structured Streaming query whose state holds one row per video.
"""

from crowdrank.streaming.scores import latest_video_scores, start_video_scores, video_scores_stream

__all__ = ["latest_video_scores", "start_video_scores", "video_scores_stream"]
