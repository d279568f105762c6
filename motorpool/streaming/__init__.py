"""The telematics feed as Structured Streaming jobs."""
