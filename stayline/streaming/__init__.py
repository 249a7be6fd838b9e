from stayline.streaming.scoring_stream import score_stream  # noqa: F401
