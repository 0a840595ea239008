"""Events as a stream: binned under a watermark, and queues that carry their depth from batch to batch."""
