"""A small tree of texts that holds one example of each framework the connectors know."""

TEXTS = {
    "shop/web/api.ts": "export async function load(id: string) {\n  await axios.get('/api/users/7');\n  await fetch('/orders', { method: 'POST' });\n  return http.get(`/v1/items/${id}`); client.delete('/bills/3');\n}\n",
    "shop/server/UsersController.cs": "namespace Shop.Server;\n[Route(\"api/[controller]\")]\npublic class UsersController\n{\n    [HttpGet(\"{id}\")]\n    public User Get(int id)\n    {\n        return Find(id);\n    }\n}\n",
    "shop/server/Program.cs": "var shop = app.MapGroup(\"orders\");\nshop.MapPost(\"/\", Create);\nservices.AddScoped<IRepo, Repo>(); services.AddSingleton<IClock, Clock>();\n",
    "shop/server/Repo.cs": "namespace Shop.Server;\npublic interface IRepo\n{\n}\npublic class Repo : IRepo\n{\n    public const string ApiUrl = \"api\";\n    public async Task Load()\n    {\n        await _http.GetAsync($\"{ApiUrl}/users/{id}?full=1\");\n    }\n\n    public async Task Save()\n    {\n        var uri = UriHelper.CombineUri(Base, $\"orders\");\n        await _http.PostAsync(uri);\n    }\n}\n",
    "shop/server/Events.cs": "namespace Shop.Server;\npublic record OrderPaid(int Id) : IntegrationEvent;\npublic class PaidHandler : IIntegrationEventHandler<OrderPaid>\n{\n}\n",
    "shop/server/Context.cs": "namespace Shop.Server;\npublic class Context : DbContext\n{\n    public DbSet<Order> Orders { get; set; }\n}\npublic class Order\n{\n    public int Id { get; set; }\n}\n",
    "shop/proto/greeter.proto": "service Greeter {\n  rpc SayHello (Ask) returns (Answer);\n}\n",
    "shop/server/Greeter.cs": "namespace Shop.Server;\npublic class GreeterBase\n{\n    public Answer SayHello(Ask ask)\n    {\n        return Reply(ask);\n    }\n}\n",
    "shop/schema.graphql": "type Query {\n  user(id: ID): User\n}\ntype User {\n  name: String\n}\n",
    "shop/py/resolvers.py": "def user(id):\n    return None\n",
    "shop/py/items.py": "router = APIRouter(\n    tags=['items'], prefix='/items')\n\n@router.get('/{item}')\nasync def read(item):\n    return item\n\napp.include_router(router, prefix='/v1')\n",
    "shop/py/urls.py": "from . import views\nurlpatterns = [\n    path('about/', views.about),\n]\n",
    "shop/py/views.py": "def about(request):\n    return render(request)\n\nclass PostView(ListView):\n    pass\n",
    "shop/py/models.py": "class Category(models.Model):\n    pass\n",
    "shop/go/main.go": "package main\nfunc serve(r *gin.Engine) {\n\tg := r.Group(\"/g\")\n\tg.GET(\"/x/:id\", show)\n\thttp.HandleFunc(\"/ping\", ping)\n}\n",
    "shop/config/routes.rb": "Rails.application.routes.draw do\n  namespace :admin do\n    resources :photos, only: [:index, :show]\n  end\nend\n",
    "shop/php/web.php": "<?php\nRoute::prefix('shop')->group(function () {\n    Route::get('/cart', [Cart::class, 'show']);\n});\n",
    "shop/java/BillingService.java": "package shop.java;\n@Service\npublic class BillingService implements Billing {\n    @KafkaListener(topics = \"paid\")\n    public void paid(String id) {\n    }\n}\n",
    "shop/java/Billing.java": "package shop.java;\npublic interface Billing {\n}\n",
    "shop/java/BillController.java": "package shop.java;\n@RestController\n@RequestMapping(\"/bills\")\npublic class BillController {\n    @DeleteMapping(\"/{id}\")\n    public void drop(String id) {\n    }\n}\n",
    "shop/nest/cats.ts": "@Controller('cats')\nexport class CatsController {\n  @Get(':id')\n  one(id: string): Cat {\n    return this.find(id);\n  }\n}\n",
    "shop/ng/data.service.ts": "@Injectable({ providedIn: 'root' })\nexport class DataService {\n}\n",
    "shop/ng/page.ts": "export class Page {\n  constructor(\n    private readonly data: DataService, private other: Unknown,\n  ) {}\n}\n",
    "shop/web/queue.ts": "export function pay() { kafka.send({ topic: 'paid' }); kafka.send({ topic: 'lost' }); }\n",
    "shop/tauri/lib.rs": "#[tauri::command]\npub async fn greet(name: String) -> String {\n    app.emit_all(\"greeted\", name);\n    name\n}\n",
    "shop/web/desk.ts": "invoke('greet'); listen('greeted', f); ipcRenderer.invoke('save');\n",
    "shop/desk/main.js": "ipcMain.handle('save', save)\n",
    "shop/web/store.ts": "export const useCartStore = create((set) => ({}));\n",
    "shop/web/Button.stories.tsx": "export default { title: 'Button' };\n",
    "other/web/api.ts": "axios.get('/api/users/7'); listen('greeted', f);\n",
}
