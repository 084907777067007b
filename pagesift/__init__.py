"""pagesift: search, extract and validate web content with Spark DataFrames.

Every public function takes and returns DataFrames or Columns. Fetching pages is left to outside
tools: fetched content enters as a table of responses and "fetch this URL" is a join on the URL.
"""
