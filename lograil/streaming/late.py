"""Counting rows behind the watermark over a stream's whole life."""
from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Sums what each query dropped as late; add it with `spark.streams.addListener` before the start.

    Spark keeps only the latest progress of a query, so a count over those would forget.
    """

    def __init__(self):
        self.dropped = defaultdict(int)

    def onQueryStarted(self, event):
        self.dropped[str(event.id)] += 0

    def onQueryProgress(self, event):
        self.dropped[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
