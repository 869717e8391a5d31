"""The same bar operators on streams."""

from finpanel.streaming.bars import first_touch_stream, lag_signal_stream, stream_downsampled  # noqa: F401
