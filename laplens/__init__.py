"""laplens: lap-timing and vehicle-telemetry analytics as Spark DataFrame operators."""
