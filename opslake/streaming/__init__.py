"""The keyed state of the engine as Structured Streaming queries; results equal the batch forms."""
