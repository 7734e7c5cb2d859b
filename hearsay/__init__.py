"""hearsay: text analytics for short posts, written as lazy Spark DataFrame plans."""
