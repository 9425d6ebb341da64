"""Small sources in each language, on which the front ends are checked by queries of fixed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GO = '''package shop

// Total adds the prices of what is in stock.
func (s *Shop) Total(items []Item, rate float64) (sum float64, err error) {
	for i, item := range items {
		if item.Stock == 0 {
			continue
		}
		sum += item.Price * rate
		s.seen[i] = true
	}
	log.Printf("%d items", len(items))
	if sum < 0 {
		return 0, errors.New("negative")
	}
	return sum, nil
}

// kindred-ignore
func Skipped(a, b int) int {
	a++
	b++
	a += b
	return a
}
'''
SCRIPT = '''export async function load(id) {
  const url = `/items/${id}`;
  const reply = await fetch(url);
  if (!reply.ok) {
    throw new Error("no reply");
  }
  return reply.json();
}
'''
RUBY = '''class Store
  def self.find(id, limit)
    rows = query("items", id)
    return [] if rows.empty?
    rows.each do |row|
      row.touch(limit)
    end
    rows.first
  end
end
'''
SHARP = '''public class Store {
    public int Sum(int[] prices) {
        var total = 0;
        foreach (var p in prices) {
            total += p;
        }
        Log("sum", total);
        return total;
    }
}
'''
OBJC = '''@implementation Store
- (int)sum:(NSArray *)prices {
    int total = 0;
    for (NSNumber *p in prices) {
        total += [p intValue];
    }
    NSLog(@"sum %d", total);
    return total;
}
@end
'''
EXAMPLES = [("shop.go", "go", GO), ("load.js", "javascript", SCRIPT), ("store.rb", "ruby", RUBY), ("Store.cs", "csharp", SHARP), ("Store.m", "objc", OBJC)]


def example_files(spark: SparkSession) -> DataFrame:
    rows = [("examples", file, language, text, False, False) for file, language, text in EXAMPLES]
    return spark.createDataFrame(rows, "root string, file string, language string, text string, is_test boolean, is_generated boolean")
